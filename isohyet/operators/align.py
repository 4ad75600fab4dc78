"""Alignment of predictors and observations, folds, and closed-form regressions on one predictor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.calendar import month_index

FOLDS = 5


def lead_align(obs: DataFrame, pred: DataFrame, lead: int, key: str | None = "loc_id", keep: list[str] | None = None) -> DataFrame:
    """(loc_id, time, x, y) and columns of obs to keep: each observation with the predictor `lead` months before. Without a key all locations
    share one predictor series."""
    p = pred.select(*([key] if key else []), F.add_months("time", lead).alias("time"), F.col("value").alias("x"))
    return obs.select("loc_id", "time", F.col("value").alias("y"), *(keep or [])).join(p, [*([key] if key else []), "time"]).select("loc_id", "time", "x", "y", *(keep or []))


def with_folds(pairs: DataFrame, folds: int = FOLDS, key: str = "loc_id") -> DataFrame:
    """Contiguous blocks in time, the first ones larger by one where rows do not divide evenly."""
    return pairs.withColumn("fold", F.ntile(folds).over(Window.partitionBy(key).orderBy("time")))


def leave_one_out(pairs: DataFrame, key: str = "loc_id") -> DataFrame:
    return pairs.withColumn("fold", F.row_number().over(Window.partitionBy(key).orderBy("time")))


def shrunk(weight: Column, n: Column, penalty: str = "ols", alpha: float | None = None) -> Column:
    """The weight on a scaled predictor under a penalty, from the least-squares weight."""
    if penalty == "ridge":
        return weight * n / (n + (1.0 if alpha is None else alpha))
    if penalty == "lasso":
        return F.signum(weight) * F.greatest(F.abs(weight) - (0.01 if alpha is None else alpha), F.lit(0.0))
    if penalty != "ols":
        raise ValueError(f"unknown penalty {penalty}")
    return weight


def out_of_fold_linear(folded: DataFrame, penalty: str = "ols", alpha: float | None = None, key: str = "loc_id", keep: list[str] | None = None) -> DataFrame:
    """(loc_id, time, y, h) and columns to keep: each row predicted by the line through all rows of other folds.

    A fold's training sums are the location's sums less the fold's own, so no row is copied per fold. Values are
    centred first, which keeps the differences exact enough. Predictors are scaled within the training rows."""
    whole = Window.partitionBy(key)
    part = Window.partitionBy(key, "fold")
    df = folded.withColumns({"_mx": F.avg("x").over(whole), "_my": F.avg("y").over(whole)}).withColumns({"_x": F.col("x") - F.col("_mx"), "_y": F.col("y") - F.col("_my")})
    x, y = F.col("_x"), F.col("_y")
    sums = {"_n": F.lit(1), "_sx": x, "_sy": y, "_sxx": x * x, "_sxy": x * y}
    df = df.withColumns({k: F.sum(v).over(whole) - F.sum(v).over(part) for k, v in sums.items()})
    n = F.nullif(F.col("_n"), F.lit(0))
    mean_x, mean_y = F.col("_sx") / n, F.col("_sy") / n
    sd = F.nullif(F.sqrt(F.greatest(F.col("_sxx") / n - mean_x * mean_x, F.lit(0.0))), F.lit(0.0))
    weight = shrunk((F.col("_sxy") / n - mean_x * mean_y) / sd, n, penalty, alpha)
    return df.select(key, "time", "y", *(keep or []), (F.col("_my") + mean_y + weight * (x - mean_x) / sd).alias("h"))


def hindcast_fit(folded: DataFrame, penalty: str = "ols", alpha: float | None = None, key: str = "loc_id", keep: list[str] | None = None) -> DataFrame:
    """(loc_id, _n, _e, correlation, and the full-sample fit) in one aggregate: errors of the cross-validated hindcast,
    its correlation with the observations, and what `standard_fit` gives; and columns that a location has once."""
    hcst = out_of_fold_linear(folded, penalty, alpha, key, keep=["x", *(keep or [])])
    cov = F.covar_pop("x", "y") / F.nullif(F.stddev_pop("x"), F.lit(0.0))
    return hcst.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.collect_list(F.col("h") - F.col("y")).alias("_e"), F.corr("h", "y").alias("correlation"),
        F.avg("x").alias("mean_x"), F.stddev_pop("x").alias("sd_x"), F.avg("y").alias("intercept"), cov.alias("w_ols"),
        *(F.max(c).alias(c) for c in keep or []),
    )


def out_of_fold_ols(folded: DataFrame, key: str = "loc_id") -> DataFrame:
    return out_of_fold_linear(folded, "ols", key=key)


def standard_fit(pairs: DataFrame, ridge: float = 1.0, lasso: float = 0.01, key: str = "loc_id") -> DataFrame:
    """Per location, intercept and weights on the predictor scaled by its population deviation: least squares, ridge
    and lasso in closed form."""
    mx, sd, my = F.avg("x"), F.stddev_pop("x"), F.avg("y")
    m = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), mx.alias("mean_x"), sd.alias("sd_x"), my.alias("intercept"), F.covar_pop("x", "y").alias("_cov"))
    z = F.col("_cov") / F.nullif(F.col("sd_x"), F.lit(0.0))  # mean of scaled x times centred y
    return m.select(key, "n", "mean_x", "sd_x", "intercept", z.alias("w_ols"), shrunk(z, F.col("n"), "ridge", ridge).alias("w_ridge"), shrunk(z, F.col("n"), "lasso", lasso).alias("w_lasso"))


def fitted(pairs: DataFrame, fit: DataFrame, weight: str = "w_ols", key: str = "loc_id") -> DataFrame:
    """(loc_id, time, y, h) with the full-sample fit applied to its own rows or others."""
    h = F.col("intercept") + F.col(weight) * (F.col("x") - F.col("mean_x")) / F.nullif(F.col("sd_x"), F.lit(0.0))
    return pairs.join(fit, key).select(key, "time", "y", h.alias("h"))


def standardized(df: DataFrame, value: str = "value", key: str = "loc_id") -> DataFrame:
    w = Window.partitionBy(key)
    return df.withColumn("z", (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0)))


def shared_times(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("time").intersect(b.select("time"))


def outer_aligned(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    left, right = (d.select("loc_id", "time", F.col("value").alias(n)) for d, n in zip((a, b), names, strict=True))
    return left.join(right, ["loc_id", "time"], "full")


def month_position(df: DataFrame) -> DataFrame:
    return df.withColumn("mi", month_index("time"))
