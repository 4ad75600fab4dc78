"""Catalogue, third part: regressions, probabilities, scores, diagnostics, interpolation, models and whole workflows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isohyet.functions import categories as cat
from isohyet.functions import skill
from isohyet.operators import align, clean, fields, lineage, models, probability, season, spatial, synthesis
from isohyet.plans.fixtures import CLIMATOLOGY, LEAD, Tables, query, rounded
from isohyet.plans.scalars import decisions, season_values

FIT_SQL = """m as (select loc_id, count(*) as n, avg(x) as mx, stddev_pop(x) as sx, avg(y) as my, covar_pop(x, y) as c from pairs
  group by 1), w as (select loc_id, my, c / nullif(sx, 0) as z, n, mx, sx from m)"""


def _standard(name: str, column: str, formula: str) -> None:
    @query(name, FIT_SQL + f" select loc_id, round(my, 3) as intercept, round({formula}, 3) as weight from w")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(align.standard_fit(Tables(spark, sf_dir).pairs()).select("loc_id", "intercept", F.col(column).alias("weight")), 3)


_standard("std_ols_1d", "w_ols", "z")
_standard("std_ridge_1d", "w_ridge", "z * n / (n + 1.0)")
_standard("std_lasso_1d", "w_lasso", "sign(z) * greatest(abs(z) - 0.01, 0)")


@query("kfold_ols", "select loc_id, cast(time as varchar) as time, y, round(h, 3) as h from hcst")
def kfold_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Tables(spark, sf_dir).hcst(), 3)


@query("loo_ols", """p as (select loc_id, time, x, y, row_number() over (partition by loc_id order by time) as k from pairs),
  f as (select a.loc_id, b.k, regr_slope(a.y, a.x) as s, regr_intercept(a.y, a.x) as i from p a
  join p b on a.loc_id = b.loc_id and a.k <> b.k group by 1, 2) select p.loc_id, cast(time as varchar) as time, y,
  round(i + s * x, 3) as h from p join f on p.loc_id = f.loc_id and p.k = f.k""")
def loo_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = Tables(spark, sf_dir).pairs().select("loc_id", "time", "x", "y")
    return rounded(align.out_of_fold_ols(align.leave_one_out(pairs)), 3)


@query("insample_estimate", FIT_SQL + " select p.loc_id, cast(time as varchar) as time, y, round(my + z * (x - mx) / nullif(sx, 0), 3) as h from pairs p join w using (loc_id)")
def insample_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Tables(spark, sf_dir).pairs()
    return rounded(align.fitted(p, align.standard_fit(p)), 3)


@query("standardize_pop", """select loc_id, cast(time as varchar) as time,
  round((value - avg(value) over (partition by loc_id)) / nullif(stddev_pop(value) over (partition by loc_id), 0), 6) as z
  from obs""")
def standardize_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.standardized(Tables(spark, sf_dir).obs()).select("loc_id", "time", "z"))


CUMULATIVE = [0.42, 0.65, 0.78, 0.87, 0.93, 0.97, 0.99, 1.0]


@query("pcr_component_count", "n as (select unnest(generate_series(4, 60)) as n) select cast(n as bigint) as n, cast(ceil(least(floor(0.15 * n), 6)) as bigint) as components from n")
def pcr_component_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, models.component_limit(n, CUMULATIVE)) for n in range(4, 61)], "n long, components long")


@query("zoning_component_count", "v(c) as (values " + ", ".join(f"({c})" for c in CUMULATIVE) + """), p as (select unnest([50, 70, 90, 95]) as pev) select cast(pev as bigint) as pev,
  count(*) filter (where round(c * 100, 1) <= pev) + 1 as components from p, v group by 1""")
def zoning_component_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame([(c,) for c in CUMULATIVE], "c double")
    held = [F.count_if(F.round(F.col("c") * 100, 1) <= p).alias(str(p)) for p in (50, 70, 90, 95)]
    wide = v.agg(*held).unpivot([], ["50", "70", "90", "95"], "pev", "n")
    return wide.select(F.col("pev").cast("long").alias("pev"), (F.col("n") + 1).alias("components"))


FORECAST_SQL = FIT_SQL + """, nx as (select loc_id, value as x from pred where time = (select max(time) from pred)),
  fc as (select loc_id, my + z * (x - mx) / nullif(sx, 0) as f from nx join w using (loc_id))"""


def _forecast(t: Tables, weight: str = "w_ols") -> DataFrame:
    """(loc_id, f) for the season that follows the last month of predictors."""
    p = t.pred()
    last = p.agg(F.max("time").alias("time"))
    new = p.join(F.broadcast(last), "time").select("loc_id", F.add_months("time", LEAD).alias("time"), F.col("value").alias("x"), F.lit(None).cast("double").alias("y"))
    return align.fitted(new, align.standard_fit(t.pairs()), weight).select("loc_id", F.col("h").alias("f"))


PROB_FORECAST_SQL = FORECAST_SQL + """, pf as (select f.loc_id, avg(case when e + f < q33 then 1.0 else 0.0 end) as p_below,
  avg(case when e + f >= q33 and e + f <= q66 then 1.0 else 0.0 end) as p_normal,
  avg(case when e + f > q66 then 1.0 else 0.0 end) as p_above from fc f join errs using (loc_id)
  join clim using (loc_id) group by 1)"""


@query("prob_forecast", PROB_FORECAST_SQL + " select loc_id, round(p_below, 6)::double as p_below, round(p_normal, 6)::double as p_normal, round(p_above, 6)::double as p_above from pf")
def prob_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(probability.forecast_probabilities(_forecast(t), t.hcst(), t.thresholds()))


def _hprobs(t: Tables, keep: list[str] | None = None) -> DataFrame:
    return probability.probabilities(t.hcst_with_thresholds(), keep=keep)


@query("prob_hindcast", """select loc_id, cast(time as varchar) as time, round(p_below, 6)::double as p_below,
  round(p_normal, 6)::double as p_normal, round(p_above, 6)::double as p_above, cast(obs_class as bigint) as obs_class
  from hp""")
def prob_hindcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_hprobs(Tables(spark, sf_dir)))


DET_SQL = {
    "correlation": "corr(h, y)",
    "mape": "avg(abs(h - y) / greatest(abs(h), 2.220446049250313e-16::double))",
    "rmse": "sqrt(avg((h - y) * (h - y)))",
    "explained_variance": "1 - var_pop(h - y) / nullif(var_pop(h), 0)",
}


def _deterministic(column: str) -> None:
    @query(f"score_{column}", f"select loc_id, round({DET_SQL[column]}, 4) as {column} from hcst group by 1")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(probability.deterministic(Tables(spark, sf_dir).hcst()).select("loc_id", column), 4)


for _name in DET_SQL:
    _deterministic(_name)


def _roc_sql(source: str) -> str:
    parts = []
    for k, c in enumerate(probability.CLASSES):
        parts.append(f"""r{k} as (select loc_id, case when obs_class = {k} then 1 else 0 end as o, rank() over (partition by loc_id
  order by p_{c}) + (count(*) over (partition by loc_id, p_{c}) - 1) / 2.0 as r from {source}),
  a{k} as (select loc_id, (sum(r * o) - sum(o) * (sum(o) + 1) / 2.0) / nullif(sum(o) * (count(*) - sum(o)), 0) as auc
  from r{k} group by 1)""")
    return ", ".join(parts)


ROUNDED_PROBS = """rp as (select loc_id, time, round(p_below, 9)::double as p_below, round(p_normal, 9)::double as p_normal,
  round(p_above, 9)::double as p_above, obs_class from hp), ep as (select loc_id, time, round(p_below, 9) as p_below,
  round(p_normal, 9) as p_normal, round(p_above, 9) as p_above, obs_class from probs)"""


def _rounded_probs(t: Tables, hindcast: bool = True) -> DataFrame:
    """Ranks need equal probabilities to be equal to the last digit on any engine."""
    return rounded(_hprobs(t) if hindcast else t.probs().drop("event_id"), 9).withColumn("obs_class", F.col("obs_class").cast("int"))


@query("score_roc", ROUNDED_PROBS + ", " + _roc_sql("rp") + """ select a0.loc_id, round(a0.auc, 6)::double as roc_below, round(a1.auc, 6)::double as roc_normal,
  round(a2.auc, 6)::double as roc_above from a0 join a1 using (loc_id) join a2 using (loc_id)""")
def score_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(probability.roc(_rounded_probs(Tables(spark, sf_dir))))


@query("score_2afc", ROUNDED_PROBS + ", " + _roc_sql("ep") + ", u as (select * from a0 union all select * from a1 union all select * from a2) select loc_id, round(avg(auc), 6)::double as two_afc from u group by 1")
def score_2afc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(probability.two_afc(_rounded_probs(Tables(spark, sf_dir), hindcast=False)))


O = [f"case when obs_class = {k} then 1.0 else 0.0 end" for k in range(3)]  # noqa: E741


def _rps_sql(a: str, b: str, c: str) -> str:
    return f"(pow({a} - {O[0]}, 2) + pow({a} + {b} - {O[0]} - {O[1]}, 2) + pow({a} + {b} + {c} - 1.0, 2))"


RPS = _rps_sql("p_below", "p_normal", "p_above")
RPS_THIRD, RPS_REVERSED = _rps_sql("(1.0::double / 3)", "(1.0::double / 3)", "(1.0::double / 3)"), _rps_sql("p_above", "p_normal", "p_below")
P_OBS = "case obs_class when 0 then p_below when 1 then p_normal else p_above end"
BOUNDED = "least(greatest({}, 1e-15::double), 1 - 1e-15::double)"
ROW_SQL = {
    "rps": ("rps", f"round(avg({RPS}), 6)::double"),
    "rpss": ("rpss", f"round(1 - avg({RPS}) / nullif(avg({RPS_THIRD}), 0), 6)::double"),
    "rpss_as_reference": ("rpss", f"round(1 - avg({RPS}) / nullif(avg({RPS_REVERSED}), 0), 6)::double"),
    "ignorance": ("ignorance", f"round(avg(-log2({BOUNDED.format(P_OBS)})), 6)::double"),
    "brier": ("brier", f"round(avg(pow(p_below - {O[0]}, 2) + pow(p_normal - {O[1]}, 2) + pow(p_above - {O[2]}, 2)), 6)::double"),
}
ROW_SCORES = {"rps": probability.rps, "rpss": probability.rpss, "rpss_as_reference": lambda d: probability.rpss(d, as_reference=True), "ignorance": probability.ignorance, "brier": probability.brier}


def _row_score(name: str) -> None:
    column, sql = ROW_SQL[name]

    @query(f"score_{name}", f"select loc_id, {sql} as {column} from probs group by 1")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(ROW_SCORES[name](Tables(spark, sf_dir).probs()))


for _name in ROW_SQL:
    _row_score(_name)

CLASS_SQL = "case when p_below >= p_normal and p_below >= p_above then 0 when p_normal >= p_above then 1 else 2 end"
HSS_SQL = "(sum(case when f = o then 1 else 0 end) - ne) / nullif(n - ne, 0)"


def _hss_sql(source: str) -> str:
    counts = " + ".join(f"count(*) filter (where f = {k}) * count(*) filter (where obs_class = {k})" for k in range(3))
    return f"""k as (select loc_id, {CLASS_SQL} as f, obs_class from {source}), c as (select loc_id,
  count(*) filter (where f = obs_class) as nc, count(*) as n, ({counts})::double / count(*) as ne from k group by 1),
  hss as (select loc_id, (nc - ne) / nullif(n - ne, 0) as hss from c)"""


@query("score_hss", _hss_sql("probs") + " select loc_id, round(hss, 6) as hss from hss")
def score_hss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(probability.heidke(Tables(spark, sf_dir).probs()))


def _gain_sql(source: str) -> str:
    return f"""g as (select loc_id, {P_OBS} as p,
  count(*) over (partition by loc_id, obs_class) * 1.0::double / count(*) over (partition by loc_id) as q
  from {source}), gain as (select loc_id, avg(log2({BOUNDED.format('p')}) - log2({BOUNDED.format('q')})) as info_gain
  from g group by 1)"""


@query("score_info_gain", _gain_sql("probs") + " select loc_id, round(info_gain, 6) as info_gain from gain")
def score_info_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(probability.information_gain(Tables(spark, sf_dir).probs()))


SKILL_SQL = (
    ROUNDED_PROBS + ", " + _roc_sql("rp") + ", " + _hss_sql("rp") + ", " + _gain_sql("rp")
    + f", det as (select loc_id, {', '.join(f'{v} as {k}' for k, v in DET_SQL.items())} from hcst group by 1), sc as (select loc_id, 1 - avg({RPS}) / nullif(avg({RPS_THIRD}), 0) as rpss, avg(-log2({BOUNDED.format(P_OBS)})) as ignorance, avg(pow(p_below - {O[0]}, 2) + pow(p_normal - {O[1]}, 2) + pow(p_above - {O[2]}, 2)) as brier from rp group by 1), wide as (select det.loc_id, correlation, mape as MAPE, rmse as RMSE, a2.auc as ROC_above, a1.auc as ROC_normal, a0.auc as ROC_below, rpss, ignorance, hss, (a0.auc + a1.auc + a2.auc) / 3 as \"2afc\", brier, info_gain as effintrate from det join a0 using (loc_id) join a1 using (loc_id) join a2 using (loc_id) join sc using (loc_id) join hss using (loc_id) join gain using (loc_id)) select loc_id, score, round(value, 4)::double as value from ("
    + " union all ".join(f"select loc_id, '{s}' as score, \"{s}\"::double as value from wide" for s in ("correlation", "MAPE", "RMSE", "ROC_above", "ROC_normal", "ROC_below", "rpss", "ignorance", "hss", "2afc", "brier", "effintrate"))
    + ")"
)


@query("skill_table", SKILL_SQL)
def skill_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rounded(_hprobs(Tables(spark, sf_dir), ["y", "h"]), 9).withColumn("obs_class", F.col("obs_class").cast("int"))
    return rounded(probability.skill_table(None, p), 4)


CELL = """cell as (select event_id, zone, fcst, obs,
  case obs when 1 then 1 when 4 then 3 else 2 end as o3, [0.40, 0.35, 0.25, 0.25][fcst]::double as p1, [0.35, 0.40, 0.40, 0.35][fcst]::double as p2, [0.25, 0.25, 0.35, 0.40][fcst]::double as p3
  from cats), co as (select *, case o3 when 1 then p1 when 2 then p2 else p3 end as po from cell)"""


def _cells(t: Tables) -> DataFrame:
    p = cat.category_probabilities(F.col("fcst"))
    c = t.cats().withColumn("o3", cat.category_tercile(F.col("obs"))).withColumns({f"p{i + 1}": F.get(p, F.lit(i)) for i in range(3)})
    return c.withColumn("po", F.when(F.col("o3") == 1, F.col("p1")).when(F.col("o3") == 2, F.col("p2")).otherwise(F.col("p3")))


@query("heidke_hit", CELL + """ select event_id,
  case when po = greatest(p1, p2, p3) then 1.0::double / ((p1 = greatest(p1, p2, p3))::int + (p2 = greatest(p1, p2, p3))::int + (p3 = greatest(p1, p2, p3))::int) else 0.0::double end as hit
  from co""")
def heidke_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(Tables(spark, sf_dir)).select("event_id", skill.heidke_hit(F.col("p1"), F.col("p2"), F.col("p3"), F.col("o3")).alias("hit"))


@query("interest_rate", CELL + " select event_id, round((po / 0.33::double - 1) * 100, 4) as rate from co")
def interest_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_cells(Tables(spark, sf_dir)).select("event_id", skill.interest_rate(F.col("po")).alias("rate")), 4)


@query("ignorance_cell", """z as (select event_id, case when event_id % 9 = 0 then 0.0 else p_below end as p from probs) select event_id,
  round(-log2(case when p = 0 then 0.01::double else p end), 6) as ignorance from z""")
def ignorance_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("event_id") % 9 == 0, 0.0).otherwise(F.col("p_below"))
    return rounded(Tables(spark, sf_dir).probs().select("event_id", skill.ignorance_of_cell(p).alias("ignorance")))


RPSS_SQL = CELL + """, r as (select *, case when obs = 1 then 1.0 else 0.0 end as o1, case when obs <= 3 then 1.0 else 0.0 end as o2
  from cell),
  cellrpss as (select *, 1 - (pow(p1 - o1, 2) + pow(p1 + p2 - o2, 2)) / (pow(0.33::double - o1, 2) + pow(0.66::double - o2, 2)) as rpss
  from r)"""


@query("rpss_cell", RPSS_SQL + " select event_id, round(rpss, 6) as rpss from cellrpss")
def rpss_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Tables(spark, sf_dir).cats().select("event_id", skill.rpss_of_cell(F.col("fcst"), F.col("obs")).alias("rpss")))


@query("cem_hit", "select event_id, 3 - abs(fcst - obs) as hit from cats")
def cem_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Tables(spark, sf_dir).cats().select("event_id", skill.category_hit(F.col("fcst"), F.col("obs")).alias("hit")))


@query("cemhit_zone_histogram", """h as (select zone, 3 - abs(fcst - obs) as hit from cats) select zone, hit, count(*) as n,
  round(count(*) * 1.0 / sum(count(*)) over (partition by zone), 6)::double as share from h group by 1, 2""")
def cemhit_zone_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = Tables(spark, sf_dir).cats().groupBy("zone", F.floor(skill.category_hit(F.col("fcst"), F.col("obs")) + 0.5).alias("hit")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(h.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("zone"))))


def _scored(t: Tables) -> DataFrame:
    c = _cells(t)
    return c.select("zone", skill.interest_rate(F.col("po")).alias("rate"), skill.ignorance_of_cell(F.col("po")).alias("ignorance"), skill.rpss_of_cell(F.col("fcst"), F.col("obs")).alias("rpss"), skill.category_hit(F.col("fcst"), F.col("obs")).alias("hit"))


SUMMARY_SQL = RPSS_SQL + """,
  sc as (select zone, (case o3 when 1 then p1 when 2 then p2 else p3 end / 0.33::double - 1) * 100 as rate, -log2(case o3 when 1 then p1 when 2 then p2 else p3 end) as ignorance, rpss, 3 - abs(fcst - obs) as hit
  from cellrpss)"""
_MEANS = "round(avg(rate), 4) as rate, round(avg(ignorance), 4) as ignorance, round(avg(rpss), 4) as rpss, round(avg(hit), 4) as hit"


def _means() -> list:
    return [F.avg(c).alias(c) for c in ("rate", "ignorance", "rpss", "hit")]


@query("score_summary", SUMMARY_SQL + f" select {_MEANS} from sc")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(Tables(spark, sf_dir)).agg(*_means()), 4)


@query("zonal_score_summary", SUMMARY_SQL + f" select zone, {_MEANS} from sc group by 1")
def zonal_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(Tables(spark, sf_dir)).groupBy("zone").agg(*_means()), 4)


RESIDUAL_SQL = FIT_SQL + """, est as (select p.loc_id, p.time, p.y, my + z * (x - mx) / nullif(sx, 0) as e from pairs p join w using (loc_id)),
  res as (select h.loc_id, h.time, h.h - h.y as outside, e.e - e.y as inside_ from hcst h
  join est e on h.loc_id = e.loc_id and h.time = e.time)"""


def _residuals(t: Tables) -> DataFrame:
    p = t.pairs()
    inside = align.fitted(p, align.standard_fit(p)).select("loc_id", "time", (F.col("h") - F.col("y")).alias("in_sample"))
    return t.hcst().select("loc_id", "time", (F.col("h") - F.col("y")).alias("out_of_sample")).join(inside, ["loc_id", "time"])


@query("residual_table", RESIDUAL_SQL + " select loc_id, cast(time as varchar) as time, round(outside, 3) as out_of_sample, round(inside_, 3) as in_sample from res")
def residual_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_residuals(Tables(spark, sf_dir)), 3)


@query("residual_histogram", RESIDUAL_SQL + """, r as (select loc_id, round(outside, 3) as v from res), l as (select loc_id, min(v) as lo, max(v) as hi from r
  group by 1) select r.loc_id, cast(least(floor((v - lo) / nullif((hi - lo) / 10, 0)), 9) as bigint) as bin,
  count(*) as n from r join l using (loc_id) group by 1, 2""")
def residual_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rounded(_residuals(Tables(spark, sf_dir)), 3).select("loc_id", F.col("out_of_sample").alias("v"))
    w = Window.partitionBy("loc_id")
    low, high = F.min("v").over(w), F.max("v").over(w)
    b = r.select("loc_id", F.least(F.floor((F.col("v") - low) / F.nullif((high - low) / 10, F.lit(0.0))), F.lit(9)).cast("long").alias("bin"))
    return b.groupBy("loc_id", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("forecast_error_distribution", FORECAST_SQL + """ select f.loc_id, cast(h.time as varchar) as time, round(f.f + h.h - h.y, 3) as value, round(q33, 3) as q33,
  round(q66, 3) as q66 from fc f join hcst h using (loc_id) join clim using (loc_id)""")
def forecast_error_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    j = t.hcst().join(_forecast(t), "loc_id").join(t.thresholds(), "loc_id")
    return rounded(j.select("loc_id", "time", (F.col("f") + F.col("h") - F.col("y")).alias("value"), "q33", "q66"), 3)


MESH_SQL = """mesh as (select r, c, 15 + c * 2.5::double as lon, -30 + r * 2.5::double as lat
  from (select unnest(generate_series(0, 8)) as r), (select unnest(generate_series(0, 8)) as c))"""


def _mesh(spark: SparkSession) -> DataFrame:
    return spatial.mesh(spark, 15, 35, -30, -10, 2.5)


@query("grid_mesh", MESH_SQL + " select r as row_idx, c as col_idx, lat, lon from mesh")
def grid_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_mesh(spark))


STATION_MEANS = "st as (select lon as slon, lat as slat, mean as v from geo join clim using (loc_id))"


def _stations(t: Tables) -> DataFrame:
    c = season.climatology(t.obs().filter(season.in_years(*CLIMATOLOGY))).select("loc_id", F.col("mean").alias("value"))
    return t.geo().join(c, "loc_id")


@query("idw_interpolate", MESH_SQL + ", " + STATION_MEANS + """, d as (select r, c, v, sqrt((lon - slon) * (lon - slon) + (lat - slat) * (lat - slat)) as d from mesh, st)
  select r as row_idx, c as col_idx, round(coalesce(max(case when d = 0 then v end),
  sum(v / nullif(d, 0)) / sum(1 / nullif(d, 0))), 5) as value from d group by 1, 2""")
def idw_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.idw(_mesh(spark), _stations(Tables(spark, sf_dir)), ["row_idx", "col_idx"]), 5)


@query("rbf_interpolate")
def rbf_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.rbf(_mesh(spark), _stations(Tables(spark, sf_dir)), ["row_idx", "col_idx"])


PLACES = ("c_custkey * 7919 % 10007 * 0.002", "c_custkey * 104729 % 10009 * 0.002")  # one for each customer


@query("rbf_reproduces", "select c_custkey, round(c_acctbal, 2) as value from customer where c_acctbal is not null")
def rbf_reproduces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radial bases over all customers, at their own places, where they must give the values back."""
    lon, lat = (F.expr(p).cast("double") for p in PLACES)
    at = Tables(spark, sf_dir).raw("customer").filter("c_acctbal is not null").select("c_custkey", lon.alias("lon"), lat.alias("lat"), F.col("c_acctbal").alias("value"))
    return rounded(models.rbf(at.select("c_custkey", "lon", "lat"), at, ["c_custkey"]), 2)


@query("pca_variance")
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.gram_pca(Tables(spark, sf_dir).raw("embeddings").select(F.col("embedding").alias("features")))


@query("pca_covariance", """e as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings)
  select a.i as i, b.i as j, round(covar_pop(a.v, b.v), 6) as cov from e a
  join e b on a.vec_id = b.vec_id and a.i <= b.i group by 1, 2""")
def pca_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.covariance(Tables(spark, sf_dir).raw("embeddings").select(F.col("embedding").alias("features"))))


@query("pca_pair_variance", """m as (select var_pop(embedding[1]::double) as a, var_pop(embedding[2]::double) as c, covar_pop(embedding[1]::double, embedding[2]::double) as b
  from embeddings), l as (select unnest([1, 2]) as k, (a + c) / 2 as h, sqrt((a - c) * (a - c) / 4 + b * b) as d from m)
  select k, round((h + case k when 1 then d else -d end) / (2 * h), 6) as variance_ratio,
  round(case k when 1 then (h + d) / (2 * h) else 1.0::double end, 6) as cumulative from l""")
def pca_pair_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal components of two columns, whose variances have a closed form."""
    pair = Tables(spark, sf_dir).raw("embeddings").select(F.slice("embedding", 1, 2).alias("features"))
    return rounded(models.gram_pca(pair))


@query("single_zone_inertia", """e as (select unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings),
  s as (select var_pop(v) * count(*) as s from e group by i) select round(sum(s), 4) as inertia from s""")
def single_zone_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first point of the elbow: the cost of one cluster."""
    return spark.createDataFrame([(round(models.total_inertia(Tables(spark, sf_dir).raw("embeddings").select(F.col("embedding").alias("features"))), 4),)], "inertia double")


def _multi(t: Tables) -> DataFrame:
    """(loc_id, time, features, y, fold): predictors of all stations of a region, three months before."""
    n = t.raw("nation").select(F.col("n_name").alias("loc_id"), F.col("n_regionkey").alias("r"))
    x = t.pred().join(n, "loc_id").groupBy("r", "time").agg(F.sort_array(F.collect_list(F.struct("loc_id", "value"))).alias("x"))
    most = x.agg(F.max(F.size("x")).alias("most"))
    x = x.join(F.broadcast(most), how="cross").filter(F.size("x") == F.col("most")).select("r", F.add_months("time", LEAD).alias("time"), F.col("x.value").alias("features"))
    y = t.obs().withColumnRenamed("value", "y").join(n, "loc_id")
    return align.with_folds(y.join(x, ["r", "time"]).select("loc_id", "time", "features", "y"))


def _model(name: str, regressor: str) -> None:
    @query(name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return models.out_of_fold(_multi(Tables(spark, sf_dir)), regressor)


for _name in ("pcr", "tree", "forest", "mlp"):
    _model(f"{_name}_hindcast", _name)


def _shared_fields(t: Tables) -> tuple[DataFrame, DataFrame, int]:
    """Predictors and observations of all stations over the months that both have."""
    x, y = t.pred().withColumn("time", F.add_months("time", LEAD)), t.obs()
    times = fields.shared_times(x, y)
    return fields.filled_field(x, times), fields.filled_field(y, times), len(times)


@query("cca_correlations")
def cca_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, n = _shared_fields(Tables(spark, sf_dir))
    every = np.arange(n)
    r = fields.canonical_parts(fields.products(x, [every], n)[0], fields.products(y, [every], n)[0], every)[-1]
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(r)], "k int, correlation double")


@query("factor_analysis_rotated")
def factor_analysis_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, y, n = _shared_fields(Tables(spark, sf_dir))
    y = lineage.cut(y)
    scaled = fields.scaled_field(y)
    u, _, s = fields.spectrum(fields.products(y, [np.arange(n)], n)[0], np.arange(n))
    found = [fields.factor_loadings(scaled, u, s, 3, r).select(F.lit(r).alias("rotation"), "loc_id", *(F.get("loadings", F.lit(i)).alias(f"f{i + 1}") for i in range(3)), "noise") for r in ("none", "varimax", "quartimax")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("kmeans_zones")
def kmeans_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).raw("embeddings").select("vec_id", F.col("embedding").alias("features"))
    return models.kmeans_zones(e, 8).select("vec_id", "zone")


FLAGSHIP_SQL = """zroll as (select loc_id, time, sum(value) over r as v, count(value) over r as n
  from zone_obs window r as (partition by loc_id
  order by year(time) * 12 + month(time) range between 2 preceding and current row)),
  sea as (select loc_id, time, v as value from zroll where n = 3 and month(time) = 3), c as (select loc_id,
  avg(value) as mean, quantile_cont(value, 0.33) as q33, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.66) as q66
  from sea where year(time) between 1995 and 2000 group by 1), qa as (select s.loc_id,
  avg(case when k.value <= s.value then 1.0 else 0.0 end) as q from sea s
  join sea k on k.loc_id = s.loc_id and year(k.time) between 1995 and 2000 where year(s.time) = 2001 group by 1)
  select s.loc_id, round(s.value, 1) as obs_value, round(mean, 2) as obs_clim,
  round((s.value - mean) / nullif(mean, 0) * 100, 3) as obs_relanom,
  cast(case when s.value <= q33 then 1 when s.value <= q66 then 2 else 3 end as bigint) as obs_terc,
  cast(case when s.value <= q33 then 1 when s.value <= q50 then 2 when s.value <= q66 then 3 else 4 end as bigint) as obs_cemcat,
  round(q, 3)::double as obs_quantanom from sea s join c using (loc_id) join qa using (loc_id) where year(s.time) = 2001"""


@query("verification_flagship", FLAGSHIP_SQL)
def verification_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed layers of one season: value, climatology, anomaly, tercile, consensus category and quantile - all from
    one aggregate by location."""
    values = season.rolling(Tables(spark, sf_dir).zone_obs(), 3, drop_empty=False).filter((F.month("time") == 3) & F.col("value").isNotNull())
    of_clim = F.when(season.in_years(*CLIMATOLOGY), F.col("value"))
    now = F.max(F.when(F.year("time") == 2001, F.col("value"))).alias("v")
    g = values.groupBy("loc_id").agg(now, F.avg(of_clim).alias("mean"), F.percentile(of_clim, F.array(*map(F.lit, (0.33, 0.5, 0.66)))).alias("q"), F.collect_list(of_clim).alias("c"))
    v, mean = F.col("v"), F.col("mean")
    q33, q50, q66 = (F.get("q", F.lit(i)) for i in range(3))
    layers = g.filter("v is not null and mean is not null").select(
        "loc_id", F.round(v, 1).alias("obs_value"), F.round(mean, 2).alias("obs_clim"), F.round((v - mean) / F.nullif(mean, F.lit(0.0)) * 100, 3).alias("obs_relanom"),
        cat.tercile(v, q33, q66).alias("obs_terc"), cat.quartile_category(v, q33, q50, q66).alias("obs_cemcat"), F.round(F.size(F.filter("c", lambda x: x <= v)) / F.size("c"), 3).alias("obs_quantanom"),
    )
    return rounded(layers)


@query("forecast_none_ols_pipeline", PROB_FORECAST_SQL + """, cor as (select loc_id, corr(h, y) as r from hcst group by 1) select f.loc_id, round(f.f, 2) as forecast,
  round(p_below, 4)::double as p_below, round(p_normal, 4)::double as p_normal, round(p_above, 4)::double as p_above,
  case when p_above >= p_normal and p_above >= p_below then 'above' when p_normal >= p_below then 'normal' else 'below' end as tercile,
  case when p_below >= p_normal and p_below >= p_above then 'below' when p_normal >= p_above then case when p_below >= p_above then 'normal-to-below' else 'normal-to-above' end else 'above' end as cem,
  round(r, 4) as correlation from fc f join pf using (loc_id) join cor using (loc_id)""")
def forecast_none_ols_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead alignment, bad-location filter, cross-validated line, forecast, probabilities, categories and skill. Hindcast
    errors, fit and skill of a location come from one aggregate over its pairs."""
    t = Tables(spark, sf_dir)
    pred = t.pred()
    fit = align.hindcast_fit(t.pairs_with_thresholds(varied=True), keep=["q33", "q66"]).filter("q33 is not null")
    last = F.max_by("value", "time").alias("x")
    newest = pred.groupBy("loc_id").agg(last, F.max("time").alias("time"))
    newest = newest.join(F.broadcast(newest.agg(F.max("time").alias("time"))), "time").select("loc_id", "x")
    f = F.col("intercept") + F.col("w_ols") * (F.col("x") - F.col("mean_x")) / F.nullif(F.col("sd_x"), F.lit(0.0))
    j = probability.shares_of_errors(fit.join(newest, "loc_id").withColumn("f", f))
    three = [F.col(c) for c in ("p_below", "p_normal", "p_above")]
    return j.select("loc_id", F.round("f", 2).alias("forecast"), *(F.round(c, 4).alias(n) for c, n in zip(three, ("p_below", "p_normal", "p_above"), strict=True)), cat.likeliest_tercile(*three).alias("tercile"), cat.likeliest_category(*three).alias("cem"), F.round("correlation", 4).alias("correlation"))


@query("synthesis_pipeline", """z as (select c_custkey as zone, c_custkey % 3 as k,
  case c_custkey % 4 when 0 then 'below normal' when 1 then 'normal to below' when 2 then 'normal to above' else 'above normal' end as category
  from customer) select category, case k when 0 then 'moderate' when 1 then 'low' else 'high' end as confidence,
  count(*) as zones from z group by 1, 2""")
def synthesis_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(Tables(spark, sf_dir))
    return synthesis.decided(d).join(synthesis.is_complete(d), "zone", "left_anti").groupBy(F.col("fcstCategory").alias("category"), F.col("confLevel").alias("confidence")).agg(F.count(F.lit(1)).alias("zones"))
