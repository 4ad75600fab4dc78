"""Catalogue, last part: workflows over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.plans import workflows as wf
from isohyet.plans.fixtures import CLIMATOLOGY, Tables, query, rounded
from isohyet.plans.scalars import SEASON_SQL
from isohyet.sources.requests import GridRequest

P = "[0.40, 0.35, 0.25, 0.25][fc]::double, [0.35, 0.40, 0.40, 0.35][fc]::double, [0.25, 0.25, 0.35, 0.40][fc]::double"
LAYERS_SQL = SEASON_SQL + """, n as (select s.loc_id, i.zone_id, s.time, s.value, c.*exclude (loc_id), case i.zone_id when '1' then 2 else 4 end as fc from sea s join sclim c using (loc_id) join inside i using (loc_id) where year(s.time) = 2001),
k as (select *, case when value <= q33 then 1 when value <= q66 then 2 else 3 end as ot, case when value <= q33 then 1 when value <= q50 then 2 when value <= q66 then 3 else 4 end as oc, """ + P.replace("[fc]::double", "[fc]::double as p{}").format(1, 2, 3) + """ from n),
po as (select *, case ot when 1 then p1 when 2 then p2 else p3 end as po, case when oc = 1 then 1.0 else 0.0 end as o1, case when oc <= 3 then 1.0 else 0.0 end as o2 from k),
qa as (select s.loc_id, avg(case when c.value <= s.value then 1.0 else 0.0 end)::double as q from sea s join sea c on c.loc_id = s.loc_id and year(c.time) between 1995 and 2000 where year(s.time) = 2001 group by 1),
layers as (select loc_id, zone_id, round_even(value, 1) as obs_value, round_even(mean, 2) as obs_clim, round_even((value - mean) / nullif(mean, 0) * 100, 0) as obs_relanom, ot as obs_terc, oc as obs_cemcat, round_even(q, 3) as obs_quantanom, fc as fcst_cemcat, case fc when 1 then 1 when 4 then 3 else 2 end as fcst_terc,
  case when po = greatest(p1, p2, p3) then 1.0::double else 0.0::double end as fcst_heidkehit, round_even((po / 0.33::double - 1) * 100, 1) as fcst_intrate, round_even(-log2(po), 2) as fcst_ignorance,
  round_even(1 - (pow(p1 - o1, 2) + pow(p1 + p2 - o2, 2)) / (pow(0.33::double - o1, 2) + pow(0.66::double - o2, 2)), 2) as fcst_rpss, 3 - abs(fc - oc) as fcst_cemhit from po join qa using (loc_id))"""
INTEGERS = ["obs_terc", "obs_cemcat", "fcst_cemcat", "fcst_terc", "fcst_cemhit"]


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    category = spark.createDataFrame([("1", "2"), ("2", "4")], "zone_id string, category string")
    return wf.verification(wf.VerificationSpec("JFM", 2001, CLIMATOLOGY), t.obs(), t.geo(), t.edges(), category).drop("time")


@query("verification_layers", LAYERS_SQL + " select * replace (" + ", ".join(f"cast({c} as bigint) as {c}" for c in INTEGERS) + ") from layers")
def verification_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_layers(spark, sf_dir).filter("obs_value is not null"))


@query("verification_summary", LAYERS_SQL + " select zone_id, " + ", ".join(f"round(avg({c}), 4)::double as {c}" for c in wf.SCORE_LAYERS) + " from layers group by 1")
def verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wf.score_means(_layers(spark, sf_dir), "zone_id"), 4)


@query("grid_request", """select cast(date_trunc('month', l_shipdate) as date)::varchar as time, lat, lon, round(avg(l_quantity), 6) as value
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
  join geo on n_name = loc_id
  where lat between -25 and -10 and lon between 15 and 30 and year(l_shipdate) between 1996 and 1999 and month(l_shipdate) in (1, 2, 3) and month(l_shipdate) % 3 between 0.5 and 2.5
  group by 1, 2, 3""")
def grid_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    n = t.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("loc_id")).join(t.geo(), "loc_id")
    grid = t.shipped().join(n, "s_nationkey").select(F.trunc("l_shipdate", "MM").alias("time"), "lat", "lon", (F.month("l_shipdate") % 3).alias("lead"), F.col("l_quantity").alias("value"))
    return rounded(GridRequest(1996, 1999, months=(1, 2, 3), box=(-25, -10, 15, 30), lead=1, seasonal=True).apply(grid))


@query("zoning_pipeline")
def zoning_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons of stations, factors, interpolation to a grid and clustering into zones; fewer than two stations without
    gaps give no zones."""
    t = Tables(spark, sf_dir)
    spec = wf.ZoningSpec((15, -30, 35, -10), step=2.5, explained=70.0, season="JFM", years=(1993, 1997))
    try:
        return wf.zoning(spec, t.obs(), t.geo())["zones"].select("row_idx", "col_idx", "zone")
    except wf.TooFewStations:
        return spark.createDataFrame([], "row_idx int, col_idx int, zone int")


@query("zoning_data", """sea as (select loc_id, time, sum(value) over r as v, count(value) over r as n
  from obs window r as (partition by loc_id
  order by year(time) * 12 + month(time) range between 2 preceding and current row)),
  s as (select loc_id, year(time) as year, v from sea
  where n = 3 and month(time) = 3 and year(time) between 1993 and 1997), y as (select count(distinct year) as years
  from s), w as (select loc_id from s group by 1 having count(*) = (select years from y)) select s.loc_id, s.year,
  round(s.v, 2) as value from s join w using (loc_id)""")
def zoning_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The season matrix that the zoning starts from: stations with every year."""
    t = Tables(spark, sf_dir)
    return rounded(wf.season_matrix(wf.ZoningSpec(season="JFM", years=(1993, 1997)), t.obs(), t.geo())[2], 2)
