"""Consensus of experts by zone: lookups and the properties of the published features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.functions.categories import CATEGORY_CODES

#: Confidence by skill level, then signal agreement.
CONFIDENCE = {
    "all low": {"low": "low", "moderate": "low", "high": "moderate"},
    "mixed/moderate": {"low": "low", "moderate": "moderate", "high": "high"},
    "all high": {"low": "moderate", "moderate": "high", "high": "very high"},
}


def literal_map(values: dict) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), literal_map(v) if isinstance(v, dict) else F.lit(v))))


def confidence(skill: Column, agreement: Column) -> Column:
    """Empty for a level that is not known."""
    return F.coalesce(F.try_element_at(F.try_element_at(literal_map(CONFIDENCE), skill), agreement), F.lit(""))


def category_code(label: Column) -> Column:
    return F.try_element_at(literal_map(CATEGORY_CODES), label)


def is_complete(decisions: DataFrame) -> DataFrame:
    """Zones whose decision lacks a field; nothing may be written while there are any."""
    fields = ["signalAgree", "skillLevel", "fcstCategory"]
    return decisions.filter(" or ".join(f"{c} is null or {c} = ''" for c in fields)).select("zone")


def decided(decisions: DataFrame) -> DataFrame:
    return decisions.withColumn("confLevel", confidence(F.col("skillLevel"), F.col("signalAgree"))).withColumn("fcstCode", category_code(F.col("fcstCategory")))


def properties(decisions: DataFrame, id_name: str, year: int, period: str) -> DataFrame:
    """(zone, properties MAP): the id and five computed properties; the confidence carries no season in its name."""
    d = decided(decisions)
    # The names of the properties.
    named = {id_name: "zone", f"finalcode_{year}-{period}": "fcstCode", f"finalcategory_{year}-{period}": "fcstCategory", "finalconfidence": "confLevel", f"agreement_{year}-{period}": "signalAgree", f"skill_{year}-{period}": "skillLevel"}
    return d.select("zone", F.create_map(*(x for n, c in named.items() for x in (F.lit(n), F.col(c).cast("string")))).alias("properties"))
