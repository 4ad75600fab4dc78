"""Seasons, climatologies and anomalies of monthly long tables (loc_id, time, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.calendar import month_index, month_of_index
from isohyet.functions.categories import TERCILE_LEVELS


def rolling(df: DataFrame, months: int, how: str = "sum", key: str = "loc_id", drop_empty: bool = True) -> DataFrame:
    """Right-aligned windows of months; null unless each month has a value. Times without any value are dropped, unless
    the caller drops nulls anyway."""
    w = Window.partitionBy(key).orderBy("_mi").rangeBetween(-(months - 1), 0)
    agg = {"sum": F.sum, "mean": F.avg}[how]("value")
    out = df.withColumn("_mi", month_index("time")).withColumn("_v", F.when(F.count("value").over(w) == months, agg.over(w)))
    out = out.select(key, "time", F.col("_v").alias("value"))
    # Times with a value: partial counts in the tasks, then a semi-join on the time axis, so no month meets in one task.
    return out.join(out.filter("value is not null").groupBy("time").agg(F.count(F.lit(1)).alias("_n")).select("time"), "time", "left_semi").select(key, "time", "value") if drop_empty else out


def resample(df: DataFrame, start_month: int, how: str = "sum", complete_only: bool = False, key: str = "loc_id") -> DataFrame:
    """Three-month seasons that start in the given month, labelled by their first month.

    By default partial seasons at the edges and in gaps count, as in quarterly resampling; a season without any value
    between a location's first and last has the sum 0 and no mean. complete_only asks for three values."""
    mi = month_index("time")
    start = (F.floor((mi - 1 - (start_month - 1)) / 3) * 3 + start_month).cast("int")  # month index of the window's start
    agg = {"sum": F.sum, "mean": F.avg}[how]("value")
    found = df.groupBy(key, start.alias("_s")).agg(agg.alias("value"), F.count("value").alias("_n"))
    found = found.filter(F.pmod(F.col("_s") - 1, F.lit(12)) == start_month - 1)
    if complete_only:
        found = found.filter("_n = 3")
    elif how == "mean":
        found = found.filter("_n > 0")
    else:
        found = found.withColumn("value", F.coalesce("value", F.lit(0.0)))
    return found.select(key, month_of_index(F.col("_s")).alias("time"), "value")


def in_years(first: int, last: int, time: str = "time") -> Column:
    return F.year(time).between(first, last)


def climatology(df: DataFrame, key: str = "loc_id") -> DataFrame:
    """(key, mean, q33, q50, q66) over all times, with exact quantiles."""
    q = F.percentile("value", F.array(F.lit(TERCILE_LEVELS[0]), F.lit(0.5), F.lit(TERCILE_LEVELS[1])))
    found = df.groupBy(key).agg(F.avg("value").alias("mean"), q.alias("q"))
    return found.select(key, "mean", *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q33", "q50", "q66"))))


def with_thresholds(df: DataFrame, first: int, last: int, key: str = "loc_id") -> DataFrame:
    """Adds q33 and q66 of the climatology years to every row of a location, by a window: rows keep one lineage."""
    q = F.percentile(F.when(in_years(first, last), F.col("value")), F.array(*map(F.lit, TERCILE_LEVELS))).over(Window.partitionBy(key))
    return df.withColumn("_q", q).select(*df.columns, F.get("_q", F.lit(0)).alias("q33"), F.get("_q", F.lit(1)).alias("q66"))


def anomalies(df: DataFrame, clim: DataFrame, keep_all: bool = False, key: str = "loc_id") -> DataFrame:
    """Absolute anomaly, percent anomaly and percent of normal. keep_all brings locations of the climatology that df
    lacks back as rows without values."""
    j = df.join(clim.select(key, "mean"), key, "full" if keep_all else "inner")
    gap, mean = F.col("value") - F.col("mean"), F.nullif(F.col("mean"), F.lit(0.0))
    return j.select(key, "time", "value", gap.alias("absolute_anomaly"), (gap / mean * 100).alias("percent_anomaly"), (F.col("value") / mean * 100).alias("percent_normal"))


def quantile_anomaly(df: DataFrame, clim_values: DataFrame, key: str = "loc_id") -> DataFrame:
    """Share of the climatology's values that are no larger than the value; a location's years are few."""
    sample = clim_values.filter("value is not null").groupBy(key).agg(F.collect_list("value").alias("_c"))
    below = F.size(F.filter("_c", lambda c: c <= F.col("value")))
    return df.join(sample, key).select(*df.columns, F.when(F.col("value").isNotNull(), below / F.size("_c")).alias("quantile"))
