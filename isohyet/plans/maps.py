"""Catalogue: rasters and polygons, grids in files, and models of whole fields."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.operators import fields, lineage, overlay, regions, spatial
from isohyet.plans.fixtures import LEAD, ORACLES, Tables, query, rounded
from isohyet.plans.relational import POLYGONS_SQL, _polygons
from isohyet.sources import netcdf

CELLS_SQL = "cells as (select c_custkey // 50 as y, c_custkey % 50 as x, c_nationkey % 4 as zone from customer)"


def _cells(t: Tables) -> DataFrame:
    """A raster of zones: a cell a customer, fifty a row."""
    k = F.col("c_custkey")
    return t.raw("customer").select(F.floor(k / 50).alias("row_idx"), (k % 50).alias("col_idx"), (F.col("c_nationkey") % 4).alias("zone"))


@query("zone_polygons")
def zone_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each connected region of the raster as a polygon: its first cell, its cells, and what its rings enclose."""
    shapes = regions.polygons(_cells(Tables(spark, sf_dir)))
    area = F.aggregate(F.transform("rings", overlay.ring_area), F.lit(0.0), lambda s, v: s + v)
    first = F.col("region")
    return rounded(shapes.select(F.shiftright(first, 32).alias("row_idx"), first.bitwiseAND(F.lit((1 << 32) - 1)).alias("col_idx"), "zone", "cells", area.alias("area"))).withColumn("zone", F.col("zone").cast("long"))


ORACLES["zone_polygons"] = f"""with recursive {CELLS_SQL},
sides as (select a.y * 50 + a.x as a, b.y * 50 + b.x as b from cells a join cells b on a.zone = b.zone and abs(a.y - b.y) + abs(a.x - b.x) = 1),
reach(cell, other) as (select y * 50 + x, y * 50 + x from cells union select r.cell, s.b from reach r join sides s on s.a = r.other),
least_ as (select cell, min(other) as region from reach group by 1)
select region // 50 as row_idx, region % 50 as col_idx, zone::bigint as zone, count(*) as cells, count(*)::double as area from least_ join cells on y * 50 + x = cell group by 1, 2, 3"""


@query("zone_smoothing", CELLS_SQL + """, near as (select a.v as dy, b.v as dx from (select unnest(range(-2, 3)) as v) a, (select unnest(range(-2, 3)) as v) b where a.v * a.v + b.v * b.v <= 4),
  grown as (select distinct y + dy as y, x + dx as x, zone from cells, near)
  select g.y as row_idx, g.x as col_idx, zone::bigint as zone from grown g join (select y, x, zone, dy, dx from grown, near) n using (y, x, zone)
  left join grown o on o.y = n.y + n.dy and o.x = n.x + n.dx and o.zone = n.zone group by 1, 2, g.zone having count(o.y) = 13""")
def zone_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones grown and shrunk by two cells."""
    return regions.smooth(_cells(Tables(spark, sf_dir)))


@query("map_clip", POLYGONS_SQL + """, country as (select loc_id, lon - 3 as x0, lat - 2 as y0, lon + 2.5 as x1, lat + 3 as y1 from geo),
  common as (select poly_id, loc_id, least(max_x, x1) - greatest(min_x, x0) as w, least(max_y, y1) - greatest(min_y, y0) as h from poly, country)
  select poly_id, loc_id, round(w * h, 6)::double as area from common where w > 0 and h > 0""")
def map_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common parts of two maps, and their areas."""
    t = Tables(spark, sf_dir)
    box = lambda a, b, c, d: F.array(F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in ((a, b), (c, b), (c, d), (a, d)))))
    one = _polygons(t).select("poly_id", box("min_x", "min_y", "max_x", "max_y").alias("rings"))
    two = t.geo().select("loc_id", (F.col("lon") - 3).alias("x0"), (F.col("lat") - 2).alias("y0"), (F.col("lon") + 2.5).alias("x1"), (F.col("lat") + 3).alias("y1"))
    both = overlay.intersection(one.withColumnRenamed("poly_id", "zone_id"), two.select(F.col("loc_id").alias("zone_id"), box("x0", "y0", "x1", "y1").alias("rings")))
    return rounded(both.select(F.col("a_id").alias("poly_id"), F.col("b_id").alias("loc_id"), overlay.ring_area(F.col("rings")[0]).alias("area")))


@query("netcdf_bounds", """select cast(time as varchar) as time, lat, lon, round(value, 6) as value from obs join geo using (loc_id)
  where time between date '1999-06-01' and date '1999-12-01' and lat between -25 and -15 and value is not null""")
def netcdf_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly grids written as NetCDF files, and read again within bounds of time and latitude."""
    t = Tables(spark, sf_dir)
    folder = f"{lineage.folder(spark)}/grids-{uuid.uuid4().hex}"
    netcdf.write(t.obs().join(t.geo(), "loc_id").select("time", "lat", "lon", "value"), folder)
    found = netcdf.read(spark, folder, "value", from_="1999-06-01", to="1999-12-01", south=-25, north=-15)
    return rounded(found.filter("value is not null").select("time", "lat", "lon", "value"))


def _fields(t: Tables) -> tuple[DataFrame, DataFrame, list]:
    x, y = t.pred().withColumn("time", F.add_months("time", LEAD)), t.obs()
    times = fields.shared_times(x, y)
    return fields.filled_field(x, times), fields.filled_field(y, times), times


def _field_model(name: str, regressor: str) -> None:
    @query(name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x, y, times = _fields(Tables(spark, sf_dir))
        n = len(times)
        fits = fields.fold_fits(n)
        kx = fields.products(x, fits, n)
        ky = fields.products(y, fits, n, scale=regressor in ("cca", "mlp"))

        def weights(i: int, fit: np.ndarray) -> np.ndarray:
            if regressor == "cca":
                return fields.canonical_weights(kx[i], ky[i], fit, n)
            return fields.shared_weights(fields.component_scores(kx[i], fit), ky[i], fit, n, regressor)

        return rounded(fields.applied(y, fields.out_of_fold_weights(weights, fits, n), times, with_values=True))

    run.__doc__ = f"Out-of-fold estimates of all stations together ({regressor}) from the predictors' components."


for _name in ("cca", "tree", "forest", "mlp"):
    _field_model(f"{_name}_field_hindcast", _name)


@query("pcr_scores")
def pcr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the predictors' principal components, a row a month and component."""
    x, _, times = _fields(Tables(spark, sf_dir))
    n = len(times)
    u, _, s = fields.spectrum(fields.products(x, [np.arange(n)], n)[0], np.arange(n))
    rows = [(times[i], j + 1, float(u[i, j] * s[j])) for i in range(n) for j in range(fields.kept_components(s, n))]
    return rounded(spark.createDataFrame(rows, "time date, k int, score double"))


@query("pcr_loadings")
def pcr_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loadings of the predictors' kept components, a row a station and component."""
    x, _, times = _fields(Tables(spark, sf_dir))
    n = len(times)
    u, _, s = fields.spectrum(fields.products(x, [np.arange(n)], n)[0], np.arange(n))
    k = fields.kept_components(s, n)
    load = fields.loadings(lineage.cut(fields.scaled_field(lineage.cut(x))), u[:, :k], s[:k]).select("loc_id", F.posexplode("loadings").alias("k", "loading"))
    return rounded(load.withColumn("k", F.col("k") + 1))
