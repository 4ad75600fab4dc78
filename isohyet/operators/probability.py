"""Empirical tercile probabilities and skill of hindcasts.

Hindcasts are (loc_id, time, y, h): observation and forecast. Probabilities are (loc_id, time, p_below, p_normal,
p_above, obs_class) with classes 0 below, 1 normal, 2 above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions import skill
from isohyet.functions.categories import likeliest_class, tercile_inclusive

CLASSES = ("below", "normal", "above")


def _errors(hcst: DataFrame, key: str) -> DataFrame:
    """Each location's forecast errors, forecast less observation, as one array: a value a year."""
    return hcst.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.collect_list(F.col("h") - F.col("y")).alias("_e"))


def _shares(centre: Column, n: Column) -> tuple[Column, Column]:
    above = F.size(F.filter("_e", lambda e: e + centre > F.col("q66"))) / n
    below = F.size(F.filter("_e", lambda e: e + centre < F.col("q33"))) / n
    return below, above


def probabilities(hcst: DataFrame, thresholds: DataFrame | None = None, key: str = "loc_id", keep: list[str] | None = None) -> DataFrame:
    """Hindcast probabilities of every year, from all of the location's errors around that year's forecast. Without a
    table of thresholds the rows have q33 and q66; locations without thresholds have no probabilities. Columns of hcst
    to keep follow."""
    below, above = _shares(F.col("h"), F.size("_e"))
    # A window keeps one lineage: every row of a location sees its errors, which are as many as its years.
    j = hcst.withColumn("_e", F.collect_list(F.col("h") - F.col("y")).over(Window.partitionBy(key)))
    j = j.join(thresholds, key) if thresholds is not None else j.filter("q33 is not null")
    p = j.select(key, "time", *dict.fromkeys(["y", *(keep or [])]), "q33", "q66", below.alias("p_below"), above.alias("p_above"))
    named = tercile_inclusive(F.col("y"), F.col("q33"), F.col("q66"))
    obs = F.when(named == "below", 0).when(named == "normal", 1).when(named == "above", 2)
    return p.select(key, "time", "p_below", (1 - (F.col("p_above") + F.col("p_below"))).alias("p_normal"), "p_above", obs.cast("int").alias("obs_class"), *(keep or []))


def forecast_probabilities(fcst: DataFrame, hcst: DataFrame, thresholds: DataFrame, key: str = "loc_id") -> DataFrame:
    """Probabilities of a forecast (loc_id, f): shares of forecast plus error beyond the thresholds."""
    return shares_of_errors(fcst.join(_errors(hcst, key), key).join(thresholds, key)).select(key, "p_below", "p_normal", "p_above")


def shares_of_errors(df: DataFrame) -> DataFrame:
    """Adds the probabilities to rows with a forecast f, its errors _e, their number _n and thresholds."""
    below, above = _shares(F.col("f"), F.col("_n"))
    normal = F.size(F.filter("_e", lambda e: (e + F.col("f") >= F.col("q33")) & (e + F.col("f") <= F.col("q66")))) / F.col("_n")
    return df.withColumns({"p_below": below, "p_normal": normal, "p_above": above})


def _ranked(df: DataFrame, key: str) -> DataFrame:
    """Mid-ranks of every class's probabilities within a location, all on one shuffle."""
    rows = F.count(F.lit(1))
    for c in CLASSES:
        ties = rows.over(Window.partitionBy(key, f"p_{c}"))
        df = df.withColumn(f"_r_{c}", F.rank().over(Window.partitionBy(key).orderBy(f"p_{c}")) + (ties - 1) / 2)
    return df


def _area(k: int, c: str) -> Column:
    """Area under the ROC curve of a class, from mid-ranks; null where the class always or never comes."""
    event, rows = skill.is_class(F.col("obs_class"), k), F.count(F.lit(1))
    n = F.sum(event)
    return ((F.sum(F.col(f"_r_{c}") * event) - n * (n + 1) / 2) / F.nullif(n * (rows - n), F.lit(0.0))).alias(f"roc_{c}")


def roc(df: DataFrame, key: str = "loc_id") -> DataFrame:
    """(key, roc_below, roc_normal, roc_above) in one aggregate."""
    return _ranked(df, key).groupBy(key).agg(*(_area(k, c) for k, c in enumerate(CLASSES)))


def two_afc(df: DataFrame, key: str = "loc_id") -> DataFrame:
    """Mean over the classes of how often an event has a higher probability than a non-event, ties half."""
    r = roc(df, key)
    held = F.filter(F.array("roc_below", "roc_normal", "roc_above"), lambda x: x.isNotNull())
    total = F.aggregate(held, F.lit(0.0), lambda a, x: a + x)
    return r.select(key, (total / F.nullif(F.size(held), F.lit(0))).alias("two_afc"))


def _p() -> tuple[Column, Column, Column]:
    return F.col("p_below"), F.col("p_normal"), F.col("p_above")


def rps(df: DataFrame, key: str = "loc_id") -> DataFrame:
    return df.groupBy(key).agg(F.avg(skill.rps(_p(), F.col("obs_class"))).alias("rps"))


def rpss(df: DataFrame, as_reference: bool = False, key: str = "loc_id") -> DataFrame:
    """Skill against equal chances of a third each; as_reference takes the hindcast with its classes in the order
    below, normal, above read as above, normal, below for the baseline."""
    third = F.lit(1.0) / 3
    base = tuple(reversed(_p())) if as_reference else (third, third, third)
    own, other = F.avg(skill.rps(_p(), F.col("obs_class"))), F.avg(skill.rps(base, F.col("obs_class")))
    return df.groupBy(key).agg((1 - own / F.nullif(other, F.lit(0.0))).alias("rpss"))


def ignorance(df: DataFrame, key: str = "loc_id") -> DataFrame:
    return df.groupBy(key).agg(F.avg(skill.ignorance(skill.observed_probability(*_p(), F.col("obs_class")))).alias("ignorance"))


def brier(df: DataFrame, key: str = "loc_id") -> DataFrame:
    return df.groupBy(key).agg(F.avg(skill.brier(*_p(), F.col("obs_class"))).alias("brier"))


def information_gain(df: DataFrame, key: str = "loc_id") -> DataFrame:
    """Mean of log2 of the observed class's probability less log2 of that class's share."""
    share = F.count(F.lit(1)).over(Window.partitionBy(key, "obs_class")) / F.count(F.lit(1)).over(Window.partitionBy(key))
    gain = -skill.ignorance(skill.observed_probability(*_p(), F.col("obs_class"))) + skill.ignorance(F.col("_share"))
    return df.withColumn("_share", share).groupBy(key).agg(F.avg(gain).alias("info_gain"))


def heidke(df: DataFrame, key: str = "loc_id") -> DataFrame:
    """(hits - expected hits) / (rows - expected hits), from counts of forecast and observed classes."""
    f, o = likeliest_class(*_p()), F.col("obs_class")
    n = F.count(F.lit(1))
    expected = sum((F.count_if(f == k) * F.count_if(o == k) for k in range(3)), F.lit(0)) / n
    return df.groupBy(key).agg(((F.count_if(f == o) - expected) / F.nullif(n - expected, F.lit(0.0))).alias("hss"))


def _deterministic() -> list[Column]:
    h, y = F.col("h"), F.col("y")
    return [F.corr("h", "y").alias("correlation"), skill.mape(h, y).alias("mape"), skill.rmse(h, y).alias("rmse"), skill.explained_variance(h, y).alias("explained_variance")]


def deterministic(hcst: DataFrame, key: str = "loc_id") -> DataFrame:
    return hcst.groupBy(key).agg(*_deterministic())


def skill_table(hcst: DataFrame | None, probs: DataFrame, as_reference: bool = False, key: str = "loc_id") -> DataFrame:
    """(loc_id, score, value) of all twelve scores. Without hcst, probs has its y and h, and one aggregate gives all."""
    obs, rows = F.col("obs_class"), F.count(F.lit(1))
    third = F.lit(1.0) / 3
    base = tuple(reversed(_p())) if as_reference else (third, third, third)
    by = Window.partitionBy(key)
    # Ranks and class shares first, all on the location, then every score in one aggregate.
    df = probs.withColumn("_share", rows.over(Window.partitionBy(key, "obs_class")) / rows.over(by))
    df = _ranked(df, key)
    p_obs, best = skill.observed_probability(*_p(), obs), likeliest_class(*_p())
    expected = sum((F.count_if(best == k) * F.count_if(obs == k) for k in range(3)), F.lit(0)) / rows
    areas = [_area(k, c) for k, c in enumerate(CLASSES)]
    scores = df.groupBy(key).agg(
        *areas,
        *([] if hcst is not None else _deterministic()),
        (1 - F.avg(skill.rps(_p(), obs)) / F.nullif(F.avg(skill.rps(base, obs)), F.lit(0.0))).alias("rpss"),
        F.avg(skill.ignorance(p_obs)).alias("ignorance"),
        ((F.count_if(best == obs) - expected) / F.nullif(rows - expected, F.lit(0.0))).alias("hss"),
        F.avg(skill.brier(*_p(), obs)).alias("brier"),
        F.avg(skill.ignorance(F.col("_share")) - skill.ignorance(p_obs)).alias("info_gain"),
    )
    held = F.filter(F.array("roc_below", "roc_normal", "roc_above"), lambda x: x.isNotNull())
    mean = F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(held), F.lit(0))
    scores = scores.withColumn("two_afc", mean)
    j = deterministic(hcst, key).join(scores, key) if hcst is not None else scores
    names = {"correlation": "correlation", "MAPE": "mape", "RMSE": "rmse", "ROC_above": "roc_above", "ROC_normal": "roc_normal", "ROC_below": "roc_below", "rpss": "rpss", "ignorance": "ignorance", "hss": "hss", "2afc": "two_afc", "brier": "brier", "effintrate": "info_gain"}
    return j.select(key, *(F.col(c).alias(n) for n, c in names.items())).unpivot(key, list(names), "score", "value")
