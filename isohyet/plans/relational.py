"""Catalogue, first part: scans and reshaping, cleaning, joins, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isohyet.functions import calendar as cal
from isohyet.functions import text as txt
from isohyet.operators import align, clean, season, spatial, synthesis
from isohyet.plans.fixtures import CLIMATOLOGY, LEAD, Tables, query, rounded
from isohyet.sources import tables as src

MONTH_LIST = ", ".join(f"'{m}'" for m in cal.MONTHS)


@query("scan_station_unpivot", """select y.loc_id, lat, lon, cast(make_date(y.y, m.m, 1) as varchar) as time, value
  from (select distinct loc_id, year(time) as y from obs) y cross join (select unnest(generate_series(1, 12)) as m) m
  join geo using (loc_id) left join obs o on o.loc_id = y.loc_id and year(o.time) = y.y and month(o.time) = m.m""")
def scan_station_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(src.months_to_rows(Tables(spark, sf_dir).wide()))


@query("unpivot_long", """select event_id, 'p_below' as category, round(p_below, 6) as p from probs union all select event_id, 'p_normal',
  round(p_normal, 6) from probs union all select event_id, 'p_above', round(p_above, 6) from probs""")
def unpivot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Tables(spark, sf_dir).probs().unpivot("event_id", ["p_below", "p_normal", "p_above"], "category", "p"))


@query("pivot_wide", "select cast(time as varchar) as time, " + ", ".join(f"max(case when loc_id = '{i}' then value end) as zone_{i}" for i in range(5)) + " from zone_obs group by 1")
def pivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Tables(spark, sf_dir).zone_obs().groupBy("time").pivot("loc_id", [str(i) for i in range(5)]).agg(F.first("value"))
    return rounded(p.withColumnsRenamed({str(i): f"zone_{i}" for i in range(5)}))


@query("index_text_parse", "select cast(last_day(time) as varchar) as time, value from zone_obs where loc_id = '0'")
def index_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Tables(spark, sf_dir).zone_obs().filter("loc_id = '0'").withColumn("mon", F.date_format("time", "MMM"))
    wide = o.groupBy(F.year("time").alias("y")).pivot("mon", cal.MONTHS).agg(F.first("value")).na.fill(99.90)
    lines = wide.select(F.concat_ws("  ", F.col("y").cast("string"), *(F.format_string("%.2f", m) for m in cal.MONTHS)).alias("value"))
    return rounded(src.parse_index_lines(lines))


@query("union_multi_source", """select btrim(regexp_replace(trim(loc_id), '[^0-9a-zA-Z]+', '_', 'g'), '_') as loc_id,
  cast(time as varchar) as time, value from obs union all select 'ZONE_' || loc_id, cast(time as varchar), value
  from zone_obs""".replace("btrim", "trim"))
def union_multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station tables as text with a sentinel, merged and read as series."""
    t = Tables(spark, sf_dir)
    zones = t.zone_obs().withColumn("loc_id", F.concat(F.lit("ZONE "), "loc_id"))
    text = lambda d: d.groupBy("loc_id", F.year("time").alias("Year")).pivot("mon", cal.MONTHS).agg(F.first("value")).na.fill(-9999.0)
    wide = [text(d.withColumn("mon", F.date_format("time", "MMM"))) for d in (t.obs(), zones)]
    raw = wide[0].unionByName(wide[1]).select(F.col("loc_id").alias("ID"), F.lit("0").alias("Lat"), F.lit("0").alias("Lon"), F.col("Year").cast("string").alias("Year"), *(F.col(m).cast("string").alias(m) for m in cal.MONTHS))
    return rounded(src.station_series(src.merged_stations(raw, -9999)).select("loc_id", "time", "value").filter("value is not null"))


@query("union_hindcast_forecast", "select loc_id, cast(time as varchar) as time, value, case when year(time) < 2001 then 'hindcast' else 'forecast' end as stream from obs")
def union_hindcast_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Tables(spark, sf_dir).obs()
    old, new = o.filter(F.year("time") < 2001), o.filter(F.year("time") >= 2001)
    return rounded(old.withColumn("stream", F.lit("hindcast")).unionByName(new.withColumn("stream", F.lit("forecast"))))


def _collection(t: Tables) -> DataFrame:
    """A GeoJSON text with a square around each station."""
    corner = lambda dx, dy: F.format_string("[%.2f,%.2f]", F.col("lon") + dx, F.col("lat") + dy)
    ring = F.concat_ws(",", *(corner(*d) for d in ((-2, -2), (2, -2), (2, 2), (-2, 2), (-2, -2))))
    f = t.geo().select(F.create_map(F.lit("id"), F.col("loc_id"), F.lit("size"), F.lit("4")).alias("properties"), F.format_string('{"type":"Polygon","coordinates":[[%s]]}', ring).alias("geometry"))
    return src.feature_collection(f)


@query("geojson_explode", "select loc_id as id, '4' as size, cast(1 as bigint) as n_rings, cast(5 as bigint) as n_points, lon - 2 as first_x, lat - 2 as first_y from geo")
def geojson_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = src.explode_features(_collection(Tables(spark, sf_dir)))
    ring = F.get("rings", F.lit(0))
    return rounded(f.select(F.try_element_at("properties", F.lit("id")).alias("id"), F.try_element_at("properties", F.lit("size")).alias("size"), F.size("rings").alias("n_rings"), F.size(ring).alias("n_points"), F.get(ring, F.lit(0))["x"].alias("first_x"), F.get(ring, F.lit(0))["y"].alias("first_y")))


@query("geojson_project", "select '{\"id\":\"' || loc_id || '\"}' as properties, lon + 2 as max_x, lat + 2 as max_y from geo")
def geojson_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = src.explode_features(_collection(Tables(spark, sf_dir)))
    corner = F.get(F.get("rings", F.lit(0)), F.lit(2))
    return rounded(f.select(F.to_json(F.map_filter("properties", lambda k, _: k == "id")).alias("properties"), corner["x"].alias("max_x"), corner["y"].alias("max_y")))


@query("json_keys", "select key, count(*) as n from (select unnest(json_keys(props)) as key from events) group by key")
def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).raw("events").select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("calendar_360_decode", """d as (select event_id, event_id % 7200 as d from events),
  p as (select event_id, 1999 + d // 360 as y, d % 360 // 30 + 1 as m, d % 30 + 1 as day from d)
  select event_id, y as year, m as month, day,
  cast(case when day <= day(last_day(make_date(y, m, 1))) then make_date(y, m, day) end as varchar) as date from p""")
def calendar_360_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, m, d = cal.days_since_360(1999, F.col("event_id") % 7200)
    return rounded(Tables(spark, sf_dir).raw("events").select("event_id", y.alias("year"), m.alias("month"), d.alias("day"), cal.date_of_360(y, m, d).alias("date")))


ENSEMBLE_SQL = """ens as (select s_nationkey as cell,
  cast(date_trunc('month', l_shipdate) as date) as time, month(l_shipdate) % 3 as lead, l_linenumber as member, l_quantity as value
  from lineitem join supplier on l_suppkey = s_suppkey), mean_ as (select cell, time, lead, avg(value) as value from ens
  group by 1, 2, 3)"""


def _ensemble_mean(t: Tables) -> DataFrame:
    e = t.shipped().select(F.col("s_nationkey").alias("cell"), F.trunc("l_shipdate", "MM").alias("time"), (F.month("l_shipdate") % 3).alias("lead"), F.col("l_quantity").alias("value"))
    return e.groupBy("cell", "time", "lead").agg(F.avg("value").alias("value"))


@query("ensemble_mean", ENSEMBLE_SQL + " select cast(cell as bigint) as cell, cast(time as varchar) as time, lead, round(value, 6) as value from mean_")
def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ensemble_mean(Tables(spark, sf_dir)))


@query("lead_mean", ENSEMBLE_SQL + """ select cast(cell as bigint) as cell,
  cast(cast(date_trunc('quarter', time) - interval 1 month as date) as varchar) as time, round(avg(value), 6) as value
  from mean_ where lead between 0 and 1.5 group by 1, 2""")
def lead_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _ensemble_mean(Tables(spark, sf_dir)).filter(F.col("lead").between(0, 1.5))
    init = F.add_months(F.trunc("time", "QUARTER"), -1)
    return rounded(m.groupBy("cell", init.alias("time")).agg(F.avg("value").alias("value")))


@query("step_12", """select loc_id, cast(time as varchar) as time, value from obs
  where (year(time) * 12 + month(time) - (select min(year(time) * 12 + month(time)) from obs)) % 12 = 0""")
def step_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = align.month_position(Tables(spark, sf_dir).obs())
    first = o.agg(F.min("mi").alias("first"))
    return rounded(o.join(F.broadcast(first), how="cross").filter((F.col("mi") - F.col("first")) % 12 == 0).select("loc_id", "time", "value"))


def _season_sql(table: str, start: int, agg: str, extra: str = "") -> str:
    return f"""s as (select loc_id,
  cast(floor((year(time) * 12 + month(time) - 1 - {start - 1}) / 3.0) as bigint) * 3 + {start} as s, {agg}(value) as value,
  count(value) as n from {table} group by 1, 2),
  seasons as (select loc_id, make_date((s - 1) // 12, (s - 1) % 12 + 1, 1) as time, value from s
  where (s - 1) % 12 = {start - 1}{extra})"""


@query("season_resample_sum", _season_sql("obs", 12, "sum") + " select loc_id, cast(time as varchar) as time, round(value, 4) as value from seasons")
def season_resample_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(season.resample(Tables(spark, sf_dir).obs(), 12, "sum"), 4)


@query("season_resample_mean", _season_sql("obs", 3, "avg", " and n = 3") + " select loc_id, cast(time as varchar) as time, round(value, 4) as value from seasons")
def season_resample_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(season.resample(Tables(spark, sf_dir).obs(), 3, "mean", complete_only=True), 4)


@query("season_mean_times3", _season_sql("zone_obs", 1, "avg", " and n > 0") + " select loc_id, cast(time as varchar) as time, round(value * 3, 4) as value from seasons")
def season_mean_times3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(season.resample(Tables(spark, sf_dir).zone_obs(), 1, "mean").withColumn("value", F.col("value") * 3), 4)


@query("predictor_month_filter", "select loc_id, cast(time as varchar) as time, value from pred where month(time) = 9")
def predictor_month_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Tables(spark, sf_dir).pred().filter(F.month("time") == 9))


@query("climatology_slice", f"select loc_id, cast(time as varchar) as time, value from obs where year(time) between {CLIMATOLOGY[0]} and {CLIMATOLOGY[1]}")
def climatology_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Tables(spark, sf_dir).obs().filter(season.in_years(*CLIMATOLOGY)))


@query("target_season_select", "select loc_id, value from obs where time = date '2001-03-01'")
def target_season_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Tables(spark, sf_dir).obs().filter(F.col("time") == F.lit("2001-03-01").cast("date")).select("loc_id", "value"))


@query("mask_negative", "select c_custkey, case when c_acctbal >= 0 then c_acctbal end as value from customer")
def mask_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).raw("customer").select("c_custkey", clean.not_negative(F.col("c_acctbal")).alias("value"))


@query("sentinel_null", "select event_id, nullif(case when event_id % 10 = 0 then -999.0::double else value end, -999.0::double) as value from events")
def sentinel_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 10 == 0, F.lit(-999.0)).otherwise(F.col("value"))
    return Tables(spark, sf_dir).raw("events").select("event_id", clean.without_sentinel(v, -999).alias("value"))


@query("drop_incomplete_locations", "select loc_id, cast(time as varchar) as time, value from grid_obs where loc_id not in (select loc_id from grid_obs where value is null)")
def drop_incomplete_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.complete_locations(Tables(spark, sf_dir).grid_obs()))


@query("bad_location_filter", """c as (select l_suppkey, l_quantity, count(*) as n from lineitem group by 1, 2), good as (select l_suppkey from c
  group by 1 having max(n) * 1.0 / sum(n) <= 0.035) select l_suppkey as loc_id, count(*) as n from lineitem
  where l_suppkey in (select l_suppkey from good) group by 1""")
def bad_location_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = Tables(spark, sf_dir).raw("lineitem").select(F.col("l_suppkey").alias("loc_id"), F.col("l_quantity").alias("value"))
    return clean.varied_locations(li, 0.035).groupBy("loc_id").agg(F.count(F.lit(1)).alias("n"))


@query("bbox_filter", "select loc_id, lat, lon from geo where lat between -25 and -10 and lon between 20 and 30")
def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).geo().filter(clean.in_box(F.col("lat"), F.col("lon"), -25, -10, 20, 30))


@query("try_cast_numeric", "select p_partkey, try_cast(case when p_partkey % 3 = 0 then p_brand else cast(p_size as varchar) end as double) as value from part")
def try_cast_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    return Tables(spark, sf_dir).raw("part").select("p_partkey", v.try_cast("double").alias("value"))


@query("category_domain_check", "select count(*) filter (where fcst + case when event_id % 50 = 0 then 4 else 0 end not in (1, 2, 3, 4)) as violations from cats")
def category_domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir).cats().withColumn("fcst", (F.col("fcst") + F.when(F.col("event_id") % 50 == 0, 4).otherwise(0)).cast("string"))
    return clean.domain_violations(c, "fcst", [1, 2, 3, 4])


@query("dedup_keep_first", "select c_nationkey, c_custkey, c_acctbal from (select *, row_number() over (partition by c_nationkey order by c_custkey) as n from customer) where n = 1".replace("c_nationkey,", "cast(c_nationkey as bigint) as c_nationkey,", 1))
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.first_by_key(Tables(spark, sf_dir).raw("customer"), ["c_nationkey"], ["c_custkey"]).select("c_nationkey", "c_custkey", "c_acctbal"))


@query("missing_report", """select loc_id, count(*) as n, count(*) - count(value) as missing,
  round((count(*) - count(value)) * 100.0 / count(*), 6)::double as missing_pct from grid_obs group by 1""")
def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.missing_report(Tables(spark, sf_dir).grid_obs()))


@query("coverage_check", f"""select cast(min(time) as varchar) as first_time,
  cast(max(time) as varchar) as last_time, year(min(time)) <= {CLIMATOLOGY[0]} and year(max(time)) >= {CLIMATOLOGY[1]} as covered
  from obs""")
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.coverage(Tables(spark, sf_dir).obs(), *CLIMATOLOGY))


@query("distinct_locations", "select distinct loc_id from pred")
def distinct_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).pred().select("loc_id").distinct()


@query("uniqueness_check", "select count(c_name) as n, count(distinct c_name) as n_distinct, count(c_name) = count(distinct c_name) as is_unique from customer")
def uniqueness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.uniqueness(Tables(spark, sf_dir).raw("customer"), "c_name")


@query("lead_lag_align", "select loc_id, cast(time as varchar) as time, x, y from pairs")
def lead_lag_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(align.lead_align(t.obs(), t.pred(), LEAD))


@query("lead_lag_align_shared", f"""i as (select time, sum(value) as x from pred group by 1) select o.loc_id,
  cast(o.time as varchar) as time, x, o.value as y from obs o
  join i on o.time = cast(i.time + interval {LEAD} month as date)""")
def lead_lag_align_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(align.lead_align(t.obs(), t.pred().groupBy("time").agg(F.sum("value").alias("value")), LEAD, key=None))


@query("time_intersect", "select cast(time as varchar) as time from (select time from obs intersect select time from pred)")
def time_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(align.shared_times(t.obs(), t.pred()))


@query("outer_align", """select coalesce(o.loc_id, p.loc_id) as loc_id,
  cast(coalesce(o.time, p.time) as varchar) as time, o.value as obs, p.value as pred from obs o full
  join pred p on o.loc_id = p.loc_id and o.time = p.time""")
def outer_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(align.outer_aligned(t.obs(), t.pred(), ("obs", "pred")))


@query("geo_attr_join", "select geo.loc_id, lat, lon, c.mean as mean from geo left join (select loc_id, round(mean, 4) as mean from clim) c using (loc_id)")
def geo_attr_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    c = season.climatology(t.obs().filter(season.in_years(*CLIMATOLOGY))).select("loc_id", "mean")
    return rounded(t.geo().join(c, "loc_id", "left"), 4)


@query("spatial_join_within", "select loc_id, zone_id from inside")
def spatial_join_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return spatial.within(t.geo(), t.edges())


@query("spatial_overlay", "select o.loc_id, i.zone_id, cast(o.time as varchar) as time, o.value from obs o join inside i using (loc_id)")
def spatial_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(t.obs().join(spatial.within(t.geo(), t.edges()), "loc_id"))


@query("spatial_clip_semi", "select loc_id, lat, lon from geo where loc_id in (select loc_id from inside)")
def spatial_clip_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return spatial.clip(t.geo(), t.edges())


@query("rasterize_zones", "select g.loc_id, i.zone_id, t.time from geo g left join inside i using (loc_id) cross join (values ('2001-03-01'), ('2001-04-01')) t(time)")
def rasterize_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    times = spark.createDataFrame([("2001-03-01",), ("2001-04-01",)], "time string")
    return spatial.rasterize(t.geo(), t.edges(), times).select("loc_id", "zone_id", "time")


DECISIONS_SQL = """dec as (select c_custkey, c_custkey % 5 as zone,
  case c_custkey % 3 when 0 then 'all low' when 1 then 'mixed/moderate' else 'all high' end as skill,
  case c_custkey % 4 when 0 then 'low' when 1 then 'moderate' when 2 then 'high' else '' end as agree from customer),
  conf as (select *,
  case skill when 'all low' then case agree when 'low' then 'low' when 'moderate' then 'low' when 'high' then 'moderate' else '' end when 'mixed/moderate' then case agree when 'low' then 'low' when 'moderate' then 'moderate' when 'high' then 'high' else '' end else case agree when 'low' then 'moderate' when 'moderate' then 'high' when 'high' then 'very high' else '' end end as confidence
  from dec)"""


@query("confidence_lookup", DECISIONS_SQL + " select c_custkey, confidence from conf")
def confidence_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    skill = F.get(F.array(*map(F.lit, ("all low", "mixed/moderate", "all high"))), (k % 3).cast("int"))
    agree = F.get(F.array(*map(F.lit, ("low", "moderate", "high", ""))), (k % 4).cast("int"))
    return Tables(spark, sf_dir).raw("customer").select("c_custkey", synthesis.confidence(skill, agree).alias("confidence"))


POLYGONS_SQL = """poly as (select s_suppkey as poly_id, s_nationkey % 5 as zone, s_suppkey * 7 % 60 - 30.0 as min_x, s_suppkey * 11 % 50 - 25.0 as min_y, s_suppkey * 7 % 60 - 30.0 + s_suppkey % 9 + 1 as max_x, s_suppkey * 11 % 50 - 25.0 + s_suppkey % 13 + 1 as max_y
  from supplier)"""


def _polygons(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k * 7 % 60 - 30).cast("double"), (k * 11 % 50 - 25).cast("double")
    return t.raw("supplier").select(k.alias("poly_id"), (F.col("s_nationkey") % 5).alias("zone"), x.alias("min_x"), y.alias("min_y"), (x + k % 9 + 1).alias("max_x"), (y + k % 13 + 1).alias("max_y"))


@query("small_polygon_clean", POLYGONS_SQL + """ select a.poly_id from poly a where exists (select 1 from poly b
  where b.zone = a.zone and b.poly_id <> a.poly_id and (b.max_x - b.min_x) * (b.max_y - b.min_y) > (a.max_x - a.min_x) * (a.max_y - a.min_y)) and exists (select 1
  from poly b
  where b.poly_id <> a.poly_id and b.min_x <= a.min_x and b.min_y <= a.min_y and b.max_x >= a.max_x and b.max_y >= a.max_y)""")
def small_polygon_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _polygons(Tables(spark, sf_dir))
    corners = [("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y")]
    rings = F.array(F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners)))
    return spatial.small_polygons(p, spatial.edges_of_rings(p.withColumn("rings", rings), "poly_id"))


@query("zone_station_mean", "select zone_id, cast(time as varchar) as time, round(avg(value), 4) as value from obs join inside using (loc_id) group by 1, 2")
def zone_station_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(spatial.zone_means(t.obs(), spatial.within(t.geo(), t.edges())), 4)


@query("zonal_stats", """z as (select distinct zone_id from edges union all select '3'), v as (select zone_id, value from inside
  join (select loc_id, value from obs where time = date '2001-03-01') using (loc_id))
  select z.zone_id, min(value) as min, max(value) as max, round(avg(value), 4) as mean, count(value) as count from z
  left join v on v.zone_id = z.zone_id group by 1""")
def zonal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    zones = t.edges().select("zone_id").union(spark.createDataFrame([("3",)], "zone_id string"))
    now = t.obs().filter(F.col("time") == F.lit("2001-03-01").cast("date"))
    return rounded(spatial.zonal_stats(now, spatial.within(t.geo(), t.edges()), zones), 4)


@query("climatology_mean", "select loc_id, round(mean, 4) as mean from clim")
def climatology_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(season.climatology(Tables(spark, sf_dir).obs().filter(season.in_years(*CLIMATOLOGY))).select("loc_id", "mean"), 4)


@query("tercile_thresholds", "select loc_id, round(q33, 4) as q33, round(q50, 4) as q50, round(q66, 4) as q66 from clim")
def tercile_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(season.climatology(Tables(spark, sf_dir).obs().filter(season.in_years(*CLIMATOLOGY))).select("loc_id", "q33", "q50", "q66"), 4)


@query("zoning_season_matrix", """s as (select loc_id, year(time) as year, sum(value) as total, count(*) as n from obs where month(time) between 1 and 3
  group by 1, 2), y as (select count(distinct year(time)) as years from obs) select loc_id, year,
  round(total, 4) as value from s where n = 3 and loc_id in (select loc_id from s where n = 3 group by loc_id
  having count(*) = (select years from y))""")
def zoning_season_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Tables(spark, sf_dir).obs()
    s = o.filter(F.month("time").between(1, 3)).groupBy("loc_id", F.year("time").alias("year")).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n")).filter("n = 3")
    years = o.agg(F.countDistinct(F.year("time")).alias("years"))
    whole = s.groupBy("loc_id").agg(F.count(F.lit(1)).alias("held")).join(F.broadcast(years), F.col("held") == F.col("years")).select("loc_id")
    return rounded(s.join(whole, "loc_id", "left_semi").select("loc_id", "year", "value"), 4)


@query("zone_multipolygon", POLYGONS_SQL + " select cast(zone as bigint) as zone, count(*) as parts, cast(min(min_x) as double) as min_x, cast(max(max_y) as double) as max_y from poly group by 1")
def zone_multipolygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.array(F.struct(F.col("min_x").alias("x"), F.col("min_y").alias("y")), F.struct(F.col("max_x").alias("x"), F.col("max_y").alias("y")))
    z = _polygons(Tables(spark, sf_dir)).groupBy("zone").agg(F.collect_list(box).alias("parts"))
    flat = F.flatten("parts")
    return rounded(z.select("zone", F.size("parts").alias("parts"), F.array_min(F.transform(flat, lambda p: p["x"])).alias("min_x"), F.array_max(F.transform(flat, lambda p: p["y"])).alias("max_y")))


@query("grid_bounds", POLYGONS_SQL + """ select cast(trunc(min(min_x) - 1) as double) as min_x, cast(trunc(min(min_y) - 1) as double) as min_y,
  cast(round_even(max(max_x) + 0.5, 0) as double) as max_x, cast(round_even(max(max_y) + 0.5, 0) as double) as max_y
  from poly""")
def grid_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.outward_bounds(_polygons(Tables(spark, sf_dir)), "min_x", "min_y", "max_x", "max_y")


@query("station_dim", "select loc_id, min(lat) as lat, min(lon) as lon from obs join geo using (loc_id) group by 1")
def station_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).wide().groupBy(F.col("ID").alias("loc_id")).agg(F.min("Lat").alias("lat"), F.min("Lon").alias("lon"))


def _rolling_sql(agg: str) -> str:
    return f"""w as (select loc_id, time, case when count(value) over r = 3 then {agg}(value) over r end as value
  from obs window r as (partition by loc_id
  order by year(time) * 12 + month(time) range between 2 preceding and current row)), n as (select *,
  count(value) over (partition by time) as n from w) select loc_id, cast(time as varchar) as time,
  round(value, 4) as value from n where n > 0"""


@query("rolling_season_sum", _rolling_sql("sum"))
def rolling_season_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(season.rolling(Tables(spark, sf_dir).obs(), 3, "sum"), 4)


@query("rolling_season_mean", _rolling_sql("avg"))
def rolling_season_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(season.rolling(Tables(spark, sf_dir).obs(), 3, "mean"), 4)


@query("kfold_assign", "select loc_id, cast(time as varchar) as time, fold from pairs")
def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Tables(spark, sf_dir).pairs().select("loc_id", "time", "fold"))


VARIANCES = [0.42, 0.23, 0.13, 0.09, 0.06, 0.04, 0.02, 0.01]
COSTS = [900.0, 410.0, 260.0, 190.0, 150.0, 128.0, 110.0, 97.0, 88.0, 80.0, 74.0, 69.0, 65.0, 61.0, 58.0, 56.0]
_VALUES = lambda xs: ", ".join(f"({i + 1}, {x}::double)" for i, x in enumerate(xs))


@query("cumulative_variance", f"v(k, ratio) as (values {_VALUES(VARIANCES)}) select cast(k as bigint) as k, ratio, round(sum(ratio) over (order by k), 6) as cumulative from v")
def cumulative_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame(list(enumerate(VARIANCES, 1)), "k long, ratio double")
    return rounded(v.withColumn("cumulative", F.sum("ratio").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))))


@query("elbow_select", f"""v(k, cost) as (values {_VALUES(COSTS)}),
  e as (select max(case when k = 1 then cost end) as c0, (max(case when k = 16 then cost end) - max(case when k = 1 then cost end)) / 15 as a
  from v), d as (select k, abs(a * k - cost + c0 - a) / sqrt(a * a + 1) as dist from v, e)
  select cast(k as bigint) as k, round(dist, 6) as dist from d order by d.dist desc, k desc limit 1""")
def elbow_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame(list(enumerate(COSTS, 1)), "k long, cost double")
    a = (COSTS[-1] - COSTS[0]) / (len(COSTS) - 1)
    d = v.withColumn("dist", F.abs(a * F.col("k") - F.col("cost") + COSTS[0] - a) / (a * a + 1) ** 0.5)
    best = d.agg(F.max(F.struct("dist", "k")).alias("b"))
    return rounded(best.select("b.k", "b.dist"))


@query("sorted_grid", "select cast(row_number() over (order by lat desc, lon) as bigint) as pos, loc_id from geo")
def sorted_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.positions(Tables(spark, sf_dir).geo()).select("pos", "loc_id"))
