"""Exact deduplication by skew-safe combining, in DataFrame operations alone.

Texts are equal when identical after lower-casing A-Z. Rows are combined in three steps, each on (digest, full
normalised text): within a task by partial aggregation, then per digest and salt, then over the salts. The winners are
handed back to the rows by digest and salt; where a digest has more than one text, by digest and text.

Rows: a null text counts as empty, and all empty texts are one group. The row with the largest doc_id stays; a null
doc_id is smaller than any other. Repeated rows - equal text and id - each give a row; `deduplicate` marks all of them
that carry the winning id as kept, and `kept_rows` hands on one of them: that whose columns come first as JSON text. An
empty table has no rows. `deduplicate` leaves extra columns out, `kept_rows` hands them on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; in pure ASCII texts that is what lower() does."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _salt(salts: int) -> Column:
    """Rows of one id are spread too, by the task that reads them."""
    return F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(salts))


def _rows(df: DataFrame, digest_of, salts: int, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, norm, rest, digest, salt); rest holds the columns to carry, so that no name of theirs can clash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("rest")] if carry else []
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text).alias("norm"), *rest)
    return rows.withColumn("digest", digest_of(F.col("norm"))).withColumn("salt", _salt(salts))


def groups(df: DataFrame, salts: int = SALTS, digest_of=digest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, norm, keep_id, group_size) of every group of equal texts."""
    salted = _rows(df, digest_of, salts, id_col, text_col).groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _answered(df: DataFrame, salts: int, digest_of, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, digest) of every row, with rest where columns are carried."""
    found = groups(df, salts, digest_of, id_col, text_col)
    by_digest = found.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    # Only groups of more than one row, and digests of more than one text, are needed to answer for the rows.
    by_digest = written(by_digest.filter("texts > 1 or group_size > 1"), "copies")
    rows = _rows(df, digest_of, salts, id_col, text_col, carry)
    own = ["rest"] if carry else []
    salted = lambda d: d.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    # Whole rows meet the copies by a shuffle at every size, so that costs grow with the rows and not by a change of plan.
    copies = salted(by_digest).hint("merge") if carry else salted(by_digest)
    plain = rows.select("doc_id", *own, "digest", "salt").join(copies, ["digest", "salt"], "left").filter("texts is null or texts = 1")
    single = F.col("texts").isNull()
    answered = plain.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(single, F.lit(1).cast("long")).otherwise(F.col("group_size")).alias("group_size"), "digest", *own
    )
    clashes = by_digest.filter("texts > 1").select("digest")
    if not clashes.isEmpty():
        few = salted(found.join(clashes, "digest", "left_semi"))
        answered = answered.unionByName(rows.join(few, ["digest", "salt", "norm"]).select("doc_id", "keep_id", "group_size", "digest", *own))
    return answered


def deduplicate(df: DataFrame, salts: int = SALTS, digest_of=digest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest."""
    return _answered(df, salts, digest_of, id_col, text_col).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def kept_rows(df: DataFrame, salts: int = SALTS, digest_of=digest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, that stay: one of each group."""
    stays = _answered(df, salts, digest_of, id_col, text_col, df.columns).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    one = stays.select("rest")
    n = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.col(id_col).cast("long")).alias("ids")).first()
    if n["ids"] < n["rows"]:
        # Only where ids repeat, or are null, can a group of several rows hold its winning id twice.
        norm = normalised(F.coalesce(F.col(f"rest.`{text_col}`").cast("string"), F.lit("")))
        several = stays.filter("group_size > 1").groupBy("digest", norm.alias("norm")).agg(F.min_by("rest", F.to_json("rest")).alias("rest"))
        one = stays.filter("group_size = 1").select("rest").unionByName(several.select("rest"))
    return one.select(*(F.col(f"rest.`{c}`").alias(c) for c in df.columns))
