"""Inputs of the catalogue: canonical tables derived from the star schema, as DataFrames and as oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions.calendar import MONTHS
from isohyet.operators.align import lead_align, with_folds
from isohyet.operators.spatial import edges_of_rings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CLIMATOLOGY = (1995, 2000)
LEAD = 3
#: Rings (x, y) of the two example zones.
ZONES = {"1": [(12.5, -32.5), (27.5, -32.5), (20.0, -7.5)], "2": [(27.6, -40.0), (40.0, -40.0), (40.0, 0.0), (27.6, 0.0)]}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its oracle; the oracle is a select, or further named tables and a select."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            body = sql.strip()
            ORACLES[name] = PRELUDE + ("\n" if body.startswith("select") else ",\n") + body
        return f

    return add


class Tables:
    """The derived tables of one folder, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _orders(self, key: str) -> DataFrame:
        o = self.raw("orders").select("o_custkey", "o_orderdate", "o_totalprice")
        c = self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
        n = self.raw("nation").select("n_nationkey", F.col(key).cast("string").alias("loc_id"))
        month = F.trunc("o_orderdate", "MM").alias("time")
        return o.join(c, "o_custkey").join(n, "n_nationkey").groupBy("loc_id", month).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))

    def obs(self) -> DataFrame:
        return self._orders("n_name")

    def zone_obs(self) -> DataFrame:
        return self._orders("n_regionkey")

    def shipped(self) -> DataFrame:
        li = self.raw("lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_shipdate", "l_quantity", "l_linenumber")
        return li.join(self.raw("supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")

    def pred(self) -> DataFrame:
        n = self.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("loc_id"))
        return self.shipped().join(n, "s_nationkey").groupBy("loc_id", F.trunc("l_shipdate", "MM").alias("time")).agg(F.sum("l_quantity").alias("value"))

    def geo(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.raw("nation").select(F.col("n_name").alias("loc_id"), (k % 5 * 5 - 30).cast("double").alias("lat"), (F.floor(k / 5) * 5 + 15).cast("double").alias("lon"))

    def edges(self) -> DataFrame:
        rows = [(z, [[{"x": x, "y": y} for x, y in ring]]) for z, ring in ZONES.items()]
        return edges_of_rings(self.spark.createDataFrame(rows, "zone_id string, rings array<array<struct<x: double, y: double>>>"))

    def wide(self) -> DataFrame:
        o = self.obs().select("loc_id", F.year("time").alias("Year"), F.date_format("time", "MMM").alias("mon"), "value")
        p = o.groupBy("loc_id", "Year").pivot("mon", MONTHS).agg(F.first("value"))
        return p.join(self.geo(), "loc_id").select(F.col("loc_id").alias("ID"), F.col("lat").alias("Lat"), F.col("lon").alias("Lon"), "Year", *MONTHS)

    def grid_obs(self) -> DataFrame:
        """Stations times all months; months without orders have a null value."""
        o = self.obs()
        months = o.agg(F.explode(F.sequence(F.min("time"), F.max("time"), F.expr("interval 1 month"))).alias("time")).select(F.col("time").cast("date").alias("time"))
        return self.geo().select("loc_id").join(F.broadcast(months), how="cross").join(o, ["loc_id", "time"], "left")

    def probs(self) -> DataFrame:
        e = F.col("event_id")
        w = [(e % m + 1).cast("double") for m in (7, 5, 3)]
        total = w[0] + w[1] + w[2]
        return self.raw("events").select("event_id", F.col("user_id").cast("string").alias("loc_id"), F.col("ts").cast("date").alias("time"), *((x / total).alias(f"p_{n}") for x, n in zip(w, ("below", "normal", "above"), strict=True)), (e * 7 % 3).cast("int").alias("obs_class"))

    def cats(self) -> DataFrame:
        return self.raw("events").select("event_id", F.col("event_type").alias("zone"), (F.col("event_id") % 4 + 1).cast("int").alias("fcst"), (F.col("user_id") % 4 + 1).cast("int").alias("obs"))

    def pairs(self) -> DataFrame:
        return with_folds(lead_align(self.obs(), self.pred(), LEAD))

    def hcst(self) -> DataFrame:
        """A plain hindcast for scores: the mean of a location's other years is too smooth, so the line of a fold."""
        from isohyet.operators.align import out_of_fold_ols

        return out_of_fold_ols(self.pairs())

    def pairs_with_thresholds(self, varied: bool = False) -> DataFrame:
        """Pairs and folds whose rows carry their location's thresholds."""
        from isohyet.operators.clean import varied_locations
        from isohyet.operators.season import with_thresholds

        obs = with_thresholds(self.obs(), *CLIMATOLOGY)
        return with_folds(lead_align(varied_locations(obs) if varied else obs, self.pred(), LEAD, keep=["q33", "q66"]))

    def hcst_with_thresholds(self) -> DataFrame:
        from isohyet.operators.align import out_of_fold_linear

        return out_of_fold_linear(self.pairs_with_thresholds(), keep=["q33", "q66"])

    def thresholds(self) -> DataFrame:
        from isohyet.operators.season import climatology, in_years

        return climatology(self.obs().filter(in_years(*CLIMATOLOGY))).select("loc_id", "q33", "q66")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, counts as BIGINT and dates as text, so that engines agree on them."""
    kinds = {"double": lambda c: F.round(c, places), "float": lambda c: F.round(F.col(c).cast("double"), places), "int": lambda c: F.col(c).cast("long"), "smallint": lambda c: F.col(c).cast("long"), "date": lambda c: F.col(c).cast("string")}
    return df.select(*(kinds.get(t, F.col)(c).alias(c) for c, t in df.dtypes))


def _edge_values() -> str:
    rows = []
    for z, ring in ZONES.items():
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            rows.append(f"('{z}', {x1}::double, {y1}::double, {x2}::double, {y2}::double)")
    return ", ".join(rows)


PRELUDE = f"""with
obs as (select n_name as loc_id, cast(date_trunc('month', o_orderdate) as date) as time, round(sum(o_totalprice), 2) as value
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2),
zone_obs as (select cast(n_regionkey as varchar) as loc_id, cast(date_trunc('month', o_orderdate) as date) as time, round(sum(o_totalprice), 2) as value
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2),
pred as (select n_name as loc_id, cast(date_trunc('month', l_shipdate) as date) as time, sum(l_quantity) as value
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2),
geo as (select n_name as loc_id, cast(n_nationkey % 5 * 5 - 30 as double) as lat, cast(n_nationkey // 5 * 5 + 15 as double) as lon from nation),
edges(zone_id, x1, y1, x2, y2) as (values {_edge_values()}),
inside as (select loc_id, zone_id from geo join edges on (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1
  group by 1, 2 having count(*) % 2 = 1),
months_ as (select cast(unnest(generate_series(min(time), max(time), interval 1 month)) as date) as time from obs),
grid_obs as (select g.loc_id, m.time, o.value from geo g cross join months_ m left join obs o on o.loc_id = g.loc_id and o.time = m.time),
weights as (select event_id, cast(user_id as varchar) as loc_id, cast(ts as date) as time, cast(event_id % 7 + 1 as double) as a, cast(event_id % 5 + 1 as double) as b, cast(event_id % 3 + 1 as double) as c,
  event_id * 7 % 3 as obs_class from events),
probs as (select event_id, loc_id, time, a / (a + b + c) as p_below, b / (a + b + c) as p_normal, c / (a + b + c) as p_above, obs_class from weights),
cats as (select event_id, event_type as zone, event_id % 4 + 1 as fcst, user_id % 4 + 1 as obs from events),
pairs as (select o.loc_id, o.time, p.value as x, o.value as y, ntile(5) over (partition by o.loc_id order by o.time) as fold
  from obs o join pred p on p.loc_id = o.loc_id and o.time = cast(p.time + interval {LEAD} month as date)),
fits as (select a.loc_id, f.fold, regr_slope(a.y, a.x) as s, regr_intercept(a.y, a.x) as i
  from pairs a join (select distinct fold from pairs) f on a.fold <> f.fold group by 1, 2),
hcst as (select p.loc_id, p.time, p.y, i + s * p.x as h from pairs p join fits f on p.loc_id = f.loc_id and p.fold = f.fold),
clim as (select loc_id, avg(value) as mean, quantile_cont(value, 0.33) as q33, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.66) as q66
  from obs where year(time) between {CLIMATOLOGY[0]} and {CLIMATOLOGY[1]} group by 1),
errs as (select loc_id, h - y as e from hcst),
hprobs as (select h.loc_id, h.time, avg(case when e.e + h.h < c.q33 then 1.0 else 0.0 end) as p_below, avg(case when e.e + h.h > c.q66 then 1.0 else 0.0 end) as p_above,
  any_value(case when h.y <= c.q33 then 0 when h.y >= c.q66 then 2 else 1 end) as obs_class
  from hcst h join errs e on e.loc_id = h.loc_id join clim c on c.loc_id = h.loc_id group by 1, 2),
hp as (select loc_id, time, p_below, 1 - (p_above + p_below) as p_normal, p_above, obs_class from hprobs)"""
