"""Cleaning and checking of long tables (loc_id, time, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_nan(v: Column) -> Column:
    """NaN as null; aggregates would spread it."""
    return F.when(~F.isnan(v), v)


def without_sentinel(v: Column, sentinel: float) -> Column:
    return F.nullif(v, F.lit(float(sentinel)))


def not_negative(v: Column) -> Column:
    return F.when(v >= 0, v)


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def complete_locations(df: DataFrame, key: str = "loc_id", value: str = "value") -> DataFrame:
    """Rows of locations without any missing value."""
    gaps = df.filter(F.col(value).isNull()).select(key).distinct()
    return df.join(gaps, key, "left_anti")


def complete_times(df: DataFrame, key: str = "time", value: str = "value") -> DataFrame:
    """Rows of times at which no location lacks a value."""
    return complete_locations(df, key, value)


def most_frequent_share(df: DataFrame, key: str = "loc_id", value: str = "value") -> DataFrame:
    """(key, share): how much of a location's rows its most frequent value has."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    rows = F.sum("n")
    held = F.max(F.when(F.col(value).isNotNull(), F.col("n")).otherwise(0))
    return counts.groupBy(key).agg((held / rows).alias("share"))


def varied_locations(df: DataFrame, most: float = 0.2, key: str = "loc_id", value: str = "value") -> DataFrame:
    """Rows of locations whose most frequent value has at most the given share."""
    good = most_frequent_share(df, key, value).filter(F.col("share") <= most).select(key)
    return df.join(good, key, "left_semi")


def first_by_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def missing_report(df: DataFrame, key: str = "loc_id", value: str = "value") -> DataFrame:
    gap = F.when(F.col(value).isNull(), 1).otherwise(0)
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(gap).alias("missing"), (F.avg(gap) * 100).alias("missing_pct"))


def coverage(df: DataFrame, first_year: int, last_year: int, time: str = "time") -> DataFrame:
    """First and last time, and whether a climatology period lies within them."""
    low, high = F.min(time), F.max(time)
    return df.agg(low.alias("first_time"), high.alias("last_time"), ((F.year(low) <= first_year) & (F.year(high) >= last_year)).alias("covered"))


def domain_violations(df: DataFrame, column: str, allowed: list[int]) -> DataFrame:
    """Count of rows whose value - a number, perhaps stored as text - is none of the allowed."""
    as_int = F.col(column).cast("string").try_cast("int")
    return df.agg(F.count_if(~F.coalesce(as_int.isin(allowed), F.lit(False))).alias("violations"))


def uniqueness(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(column).alias("n"), F.countDistinct(column).alias("n_distinct"), (F.count(column) == F.countDistinct(column)).alias("is_unique"))
