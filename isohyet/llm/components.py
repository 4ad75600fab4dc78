"""Connected components of a table of links, by label propagation with shortcuts in Spark joins.

Every round takes the smallest label among neighbours and then the label of that label, so the number of rounds grows
with the logarithm of a component's width, not with its size. Labels are written to the shared folder in each round;
the driver sees only a count of changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import written


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links; component is the smallest node that can be reached.

    Null ends, loops and repeated links do no harm; no links give no rows."""
    one = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = written(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("u").alias("v"), F.col("label").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
        lower = labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("next"))
        new = written(lower.join(jump, "label", "left").select("u", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        if new.filter("old <> label").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("label").alias("component"))
        labels = new.select("u", "label")
