"""Catalogue, second part: scalar functions on dates, names, numbers and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions import calendar as cal
from isohyet.functions import categories as cat
from isohyet.functions import text as txt
from isohyet.operators import season, spatial, synthesis
from isohyet.plans.fixtures import CLIMATOLOGY, Tables, query, rounded

MONTH_SQL = "[" + ", ".join(f"'{m}'" for m in cal.MONTHS) + "]"


@query("month_name_to_int", f"select o_orderkey, strftime(o_orderdate, '%b') as name, cast(list_position({MONTH_SQL}, strftime(o_orderdate, '%b')) as bigint) as month from orders")
def month_name_to_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.date_format("o_orderdate", "MMM")
    return rounded(Tables(spark, sf_dir).raw("orders").select("o_orderkey", name.alias("name"), cal.month_number(name).alias("month")))


SEASON_VALUES = ", ".join(f"('{c}', {n}, {m})" for c, n, m in cal.season_table())


@query("season_param_lookup", f"""t(code, months, last_month) as (values {SEASON_VALUES}), k as (select event_id, (select list(code order by code)
  from t)[event_id % 36 + 1] as code from events) select event_id, code, cast(months as bigint) as months,
  cast(last_month as bigint) as last_month from k join t using (code)""")
def season_param_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sorted(c for c, _, _ in cal.season_table())
    dim = spark.createDataFrame(cal.season_table(), "code string, months int, last_month int")
    e = Tables(spark, sf_dir).raw("events").select("event_id", F.get(F.array(*map(F.lit, codes)), (F.col("event_id") % 36).cast("int")).alias("code"))
    return rounded(e.join(F.broadcast(dim), "code").select("event_id", "code", "months", "last_month"))


TARGETS = [f"{cal.MONTHS[i]}-{cal.MONTHS[(i + 2) % 12]}" for i in range(12)] + cal.MONTHS
TARGET_SQL = "t(target) as (values " + ", ".join(f"('{t}')" for t in TARGETS) + ")"


def _targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TARGETS], "target string")


@query("season_parse", TARGET_SQL + f" select target, cast(list_position({MONTH_SQL}, left(target, 3)) as bigint) as start_month, length(target) > 3 as seasonal from t")
def season_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("target")
    return rounded(_targets(spark).select("target", cal.season_start(t).alias("start_month"), cal.is_seasonal(t).alias("seasonal")))


@query("lead_time", TARGET_SQL + f""", s as (select unnest(generate_series(1, 12)) as source),
  l as (select source, target, (list_position({MONTH_SQL}, left(target, 3)) - source + 12) % 12 as lead from s, t)
  select cast(source as bigint) as source, target,
  cast(lead as bigint) as lead, lead <= 6 as forecast_ok, lead between 1 and 6 as download_ok from l""")
def lead_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.range(1, 13).withColumnRenamed("id", "source").join(F.broadcast(_targets(spark)), how="cross")
    lead = cal.lead_months(F.col("source"), cal.season_start(F.col("target")))
    return rounded(pairs.select("source", "target", lead.alias("lead"), cal.lead_is_valid(lead).alias("forecast_ok"), cal.lead_is_valid(lead, 1).alias("download_ok")))


@query("season_end_year", f"""t(code, months, last_month) as (values {SEASON_VALUES}) select code, cast(y as bigint) as year,
  cast(case when last_month - months < 0 then y + 1 else y end as bigint) as end_year from t cross
  join (select distinct year(o_orderdate) as y from orders)""")
def season_end_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = spark.createDataFrame(cal.season_table(), "code string, months int, last_month int")
    years = Tables(spark, sf_dir).raw("orders").select(F.year("o_orderdate").alias("year")).distinct()
    j = years.join(F.broadcast(dim), how="cross")
    return rounded(j.select("code", "year", cal.season_end_year(F.col("year"), F.col("months"), F.col("last_month")).alias("end_year")))


@query("month_snap", "select o_orderkey, cast(cast(date_trunc('month', o_orderdate) as date) as varchar) as month from orders")
def month_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Tables(spark, sf_dir).raw("orders").select("o_orderkey", cal.snap(F.col("o_orderdate")).alias("month")))


@query("fix_name", "select p_partkey, trim(regexp_replace(trim(' ' || p_name || ' (' || p_brand || ') '), '[^0-9a-zA-Z]+', '_', 'g'), '_') as name from part")
def fix_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).raw("part").select("p_partkey", txt.fix_name(F.concat(F.lit(" "), "p_name", F.lit(" ("), "p_brand", F.lit(") "))).alias("name"))


@query("sanitize_string", r"""select p_partkey, left(trim(regexp_replace(regexp_replace('. ' || p_name || '//:' || p_type || '*_?. ', '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '_+', '_', 'g'), ' .'), 255) as name from part""")
def sanitize_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).raw("part").select("p_partkey", txt.sanitize(F.concat(F.lit(". "), "p_name", F.lit("//:"), "p_type", F.lit("*_?. "))).alias("name"))


@query("is_number", "select p_partkey, try_cast(case when p_partkey % 2 = 0 then p_brand else cast(p_retailprice as varchar) end as double) is not null as is_number from part")
def is_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_retailprice").cast("string"))
    return Tables(spark, sf_dir).raw("part").select("p_partkey", txt.is_number(v).alias("is_number"))


@query("sizeof_fmt", "b as (select o_orderkey, o_totalprice * o_orderkey as b from orders) select o_orderkey, case " + " ".join(f"when b < {1024.0 ** (i + 1):.1f} then printf('%.1f{u}', b / {1024.0**i:.1f})" for i, u in enumerate(("B", "KiB", "MiB", "GiB", "TiB"))) + " end as size from b")
def sizeof_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).raw("orders").select("o_orderkey", txt.size_label(F.col("o_totalprice") * F.col("o_orderkey")).alias("size"))


@query("duration_format", """s as (select o_orderkey, o_orderkey * 37 % 86400 as s from orders)
  select o_orderkey, printf('%d hour(s) %d minute(s) %d second(s)', s // 3600, s % 3600 // 60, s % 60) as duration
  from s""")
def duration_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).raw("orders").select("o_orderkey", txt.duration_label(F.col("o_orderkey") * 37).alias("duration"))


@query("distance_matrix", "select a.loc_id, b.loc_id as to_id, round(sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)), 6) as distance from geo a, geo b")
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Tables(spark, sf_dir).geo()
    return rounded(spatial.distances(g, g))


@query("nice_limits", """m as (select loc_id, min(value) - 0.05::double * (max(value) - min(value)) as a,
  max(value) + 0.05::double * (max(value) - min(value)) as b from obs group by 1),
  s as (select *, pow(10.0::double, floor(log10(nullif(b - a, 0)))) as step from m) select loc_id,
  round(floor(a / step) * step, 4) as low, round(ceil(b / step) * step, 4) as high from s""")
def nice_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Tables(spark, sf_dir).obs().groupBy("loc_id").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    low, high = cat.nice_limits(F.col("a"), F.col("b"))
    return rounded(m.select("loc_id", low.alias("low"), high.alias("high")), 4)


@query("category_codes", """select event_id,
  case fcst when 1 then 'below normal' when 2 then 'normal to below' when 3 then 'normal to above' else 'above normal' end as label, fcst as code
  from cats""")
def category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(*map(F.lit, cat.CATEGORY_CODES))
    c = Tables(spark, sf_dir).cats().withColumn("label", F.get(labels, F.col("fcst") - 1))
    return rounded(c.select("event_id", "label", synthesis.category_code(F.col("label")).alias("code")))


@query("path_format", """select loc_id,
  cast(time as varchar) as time, 'out/' || strftime(time, '%Y%m') || '_Dec-Feb/' || trim(regexp_replace(trim(loc_id), '[^0-9a-zA-Z]+', '_', 'g'), '_') || '/pr/none_ols_kfold/output' as path
  from obs""")
def path_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.format_string("out/%s_Dec-Feb/%s/pr/none_ols_kfold/output", F.date_format("time", "yyyyMM"), txt.fix_name(F.col("loc_id")))
    return rounded(Tables(spark, sf_dir).obs().select("loc_id", "time", path.alias("path")))


@query("date_spine", "select cast(time as varchar) as time from months_")
def date_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Tables(spark, sf_dir).obs().agg(F.min("time").alias("a"), F.max("time").alias("b"))
    return rounded(o.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("time")).select(F.col("time").cast("date").alias("time")))


@query("month_end", "select o_orderkey, cast(last_day(cast(o_orderdate as date)) as varchar) as month_end from orders")
def month_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Tables(spark, sf_dir).raw("orders").select("o_orderkey", F.last_day("o_orderdate").alias("month_end")))


def _binned_sql(value: str, breaks: list[float]) -> str:
    return "cast(" + " + ".join(f"case when {value} >= {b} then 1 else 0 end" for b in breaks) + " as bigint)"


#: Upper ends of rain classes in mm, and breaks of anomaly displays in percent.
RAIN_BREAKS = [10.0, 20.0, 40.0, 50.0, 60.0, 80.0, 100.0, 125.0, 150.0, 175.0, 200.0, 250.0, 300.0, 350.0, 400.0, 500.0, 600.0, 800.0]
PERCENTILE_BREAKS = [0.0, 10.0, 20.0, 30.0, 70.0, 80.0, 90.0, 100.0]
RELATIVE_BREAKS = [float(x) for x in range(-100, 101, 20)]


@query("rainfall_class_bins", f"select l_orderkey, l_linenumber::bigint as l_linenumber, {_binned_sql('l_extendedprice / 100.0::double', RAIN_BREAKS)} as class from lineitem")
def rainfall_class_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = Tables(spark, sf_dir).raw("lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber", cat.binned(F.col("l_extendedprice") / 100.0, RAIN_BREAKS).alias("class")))


@query("anomaly_class_bins", f"""select event_id, {_binned_sql('(event_id % 101)', PERCENTILE_BREAKS)} as percentile_class, {_binned_sql('(event_id % 301 - 150)', RELATIVE_BREAKS)} as relative_class
  from events""")
def anomaly_class_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return rounded(Tables(spark, sf_dir).raw("events").select("event_id", cat.binned(k % 101, PERCENTILE_BREAKS).alias("percentile_class"), cat.binned(k % 301 - 150, RELATIVE_BREAKS).alias("relative_class")))


SEASON_SQL = """roll as (select loc_id, time, sum(value) over r as v, count(value) over r as n
  from obs window r as (partition by loc_id
  order by year(time) * 12 + month(time) range between 2 preceding and current row)),
  sea as (select loc_id, time, v as value from roll where n = 3 and month(time) = 3), sclim as (select loc_id,
  avg(value) as mean, quantile_cont(value, 0.33) as q33, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.66) as q66
  from sea where year(time) between 1995 and 2000 group by 1)"""


def season_values(t: Tables, zones: bool = False) -> tuple[DataFrame, DataFrame]:
    """January to March sums, and their climatology."""
    s = season.rolling(t.zone_obs() if zones else t.obs(), 3, drop_empty=False).filter((F.month("time") == 3) & F.col("value").isNotNull())
    return s, season.climatology(s.filter(season.in_years(*CLIMATOLOGY)))


@query("anomaly_all", SEASON_SQL + """ select loc_id, cast(time as varchar) as time, round(value, 4) as value, round(value - mean, 4) as absolute_anomaly,
  round((value - mean) / nullif(mean, 0) * 100, 4) as percent_anomaly,
  round(value / nullif(mean, 0) * 100, 4) as percent_normal from sea join sclim using (loc_id)""")
def anomaly_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(season.anomalies(*season_values(Tables(spark, sf_dir))), 4)


@query("relative_anomaly", SEASON_SQL + " select loc_id, round((value - mean) / nullif(mean, 0) * 100, 4) as relanom from sea join sclim using (loc_id) where year(time) = 2001")
def relative_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = season_values(Tables(spark, sf_dir))
    return rounded(season.anomalies(s.filter(F.year("time") == 2001), c).select("loc_id", F.col("percent_anomaly").alias("relanom")), 4)


def _classified(name: str, expression, columns: list[str], case: str) -> None:
    @query(name, SEASON_SQL + f" select loc_id, cast(time as varchar) as time, {case} as class from sea join sclim using (loc_id)")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s, c = season_values(Tables(spark, sf_dir))
        return rounded(s.join(c, "loc_id").select("loc_id", "time", expression(F.col("value"), *map(F.col, columns)).alias("class")))


_classified("observed_tercile", cat.tercile, ["q33", "q66"], "cast(case when value <= q33 then 1 when value <= q66 then 2 else 3 end as bigint)")
_classified("observed_tercile_inclusive", cat.tercile_inclusive, ["q33", "q66"], "case when value <= q33 then 'below' when value >= q66 then 'above' else 'normal' end")
_classified("observed_cem_category", cat.quartile_category, ["q33", "q50", "q66"], "cast(case when value <= q33 then 1 when value <= q50 then 2 when value <= q66 then 3 else 4 end as bigint)")


@query("cem_to_tercile", "select event_id, cast(case fcst when 1 then 1 when 4 then 3 else 2 end as bigint) as tercile from cats")
def cem_to_tercile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Tables(spark, sf_dir).cats().select("event_id", cat.category_tercile(F.col("fcst")).alias("tercile")))


@query("cem_to_probability", """select event_id, cast([0.40, 0.35, 0.25, 0.25][fcst] as double) as p_below,
  cast([0.35, 0.40, 0.40, 0.35][fcst] as double) as p_normal, cast([0.25, 0.25, 0.35, 0.40][fcst] as double) as p_above
  from cats""")
def cem_to_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cat.category_probabilities(F.col("fcst"))
    return Tables(spark, sf_dir).cats().select("event_id", *(F.get(p, F.lit(i)).alias(n) for i, n in enumerate(("p_below", "p_normal", "p_above"))))


_P = ("p_below", "p_normal", "p_above")


@query("tercile_category", """select event_id,
  case when p_above >= p_normal and p_above >= p_below then 'above' when p_normal >= p_below then 'normal' else 'below' end as category
  from probs""")
def tercile_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).probs().select("event_id", cat.likeliest_tercile(*map(F.col, _P)).alias("category"))


@query("cem_category", """select event_id,
  case when p_below >= p_normal and p_below >= p_above then 'below' when p_normal >= p_above then case when p_below >= p_above then 'normal-to-below' else 'normal-to-above' end else 'above' end as category
  from probs""")
def cem_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).probs().select("event_id", cat.likeliest_category(*map(F.col, _P)).alias("category"))


@query("quantile_anomaly", SEASON_SQL + """ select s.loc_id, cast(s.time as varchar) as time,
  round(avg(case when c.value <= s.value then 1.0 else 0.0 end), 6)::double as quantile from sea s
  join sea c on c.loc_id = s.loc_id and year(c.time) between 1995 and 2000 group by 1, 2""")
def quantile_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = season_values(Tables(spark, sf_dir))
    return rounded(season.quantile_anomaly(s, s.filter(season.in_years(*CLIMATOLOGY))).select("loc_id", "time", "quantile"))


@query("synthesis_properties", """z as (select c_custkey as zone,
  case c_custkey % 3 when 0 then 'all low' when 1 then 'mixed/moderate' else 'all high' end as skill,
  case c_custkey % 3 when 0 then 'high' when 1 then 'low' else 'moderate' end as agree,
  case c_custkey % 4 when 0 then 'below normal' when 1 then 'normal to below' when 2 then 'normal to above' else 'above normal' end as category,
  cast(c_custkey % 4 + 1 as varchar) as code from customer)
  select cast(zone as varchar) as zone, code as finalcode, category as finalcategory,
  case c when 0 then 'moderate' when 1 then 'low' else 'high' end as finalconfidence, agree as agreement, skill
  from (select *, zone % 3 as c from z)""")
def synthesis_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = synthesis.properties(decisions(Tables(spark, sf_dir)), "Zone", 2001, "JFM")
    get = lambda n: F.try_element_at("properties", F.lit(n))
    return p.select("zone", get("finalcode_2001-JFM").alias("finalcode"), get("finalcategory_2001-JFM").alias("finalcategory"), get("finalconfidence").alias("finalconfidence"), get("agreement_2001-JFM").alias("agreement"), get("skill_2001-JFM").alias("skill"))


def decisions(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda options, n: F.get(F.array(*map(F.lit, options)), (k % n).cast("int"))
    return t.raw("customer").select(k.cast("string").alias("zone"), pick(("high", "low", "moderate"), 3).alias("signalAgree"), pick(("all low", "mixed/moderate", "all high"), 3).alias("skillLevel"), pick(tuple(cat.CATEGORY_CODES), 4).alias("fcstCategory"))
