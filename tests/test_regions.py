"""Zone rasters to polygons and back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.operators import regions, spatial
from isohyet.plans import workflows as wf


def raster(spark, zones, origin=(0, 0)):
    """A table of the cells of an array; -1 means no cell."""
    y, x = np.nonzero(zones >= 0)
    return spark.createDataFrame([(int(a) + origin[0], int(b) + origin[1], int(zones[a, b])) for a, b in zip(y, x, strict=True)], "row_idx int, col_idx int, zone int")


def flooded(zones):
    """Regions by flood fill over sides."""
    out, n = np.full(zones.shape, -1), 0
    for start in np.argwhere(zones >= 0):
        if out[tuple(start)] >= 0:
            continue
        todo, out[tuple(start)] = [tuple(start)], n
        while todo:
            y, x = todo.pop()
            for a, b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= a < zones.shape[0] and 0 <= b < zones.shape[1] and out[a, b] < 0 and zones[a, b] == zones[y, x]:
                    out[a, b] = n
                    todo.append((a, b))
        n += 1
    return out


def spiral(n):
    z = np.zeros((n, n), int)
    top, left, bottom, right = 0, 0, n - 1, n - 1
    while top <= bottom and left <= right:
        z[top, left : right + 1] = 1
        z[top : bottom + 1, right] = 1
        z[bottom, left + (2 if left else 0) : right + 1] = 1
        top, left, bottom, right = top + 2, left + 2, bottom - 2, right - 2
    return z


RASTERS = {
    "noise": np.random.default_rng(3).integers(0, 3, (21, 17)),
    "holes": np.kron(np.array([[1, 1, 1, 1], [1, 2, 1, 2], [1, 1, 1, 1], [2, 1, 2, -1]]), np.ones((3, 3), int)),
    "spiral": spiral(19),
    "checked": np.indices((9, 9)).sum(0) % 2,
    "single": np.array([[5]]),
}


@pytest.mark.parametrize("name", RASTERS)
def test_polygons_give_the_raster_back(spark, name):
    zones = RASTERS[name]
    cells = raster(spark, zones, (-7, 3))
    got = regions.regions(cells, tile=5).toPandas()
    expected = flooded(zones)
    pairs = {(r.region, expected[r.row_idx + 7, r.col_idx - 3]) for r in got.itertuples()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == expected.max() + 1
    shapes = regions.polygons(cells, tile=5, min_x=10.0, min_y=-4.0, step=0.5).persist()
    edges = spatial.edges_of_rings(shapes, "region")
    points = cells.select(F.concat_ws(",", "row_idx", "col_idx").alias("loc_id"), (F.col("row_idx") * 0.5 - 4).alias("lat"), (F.col("col_idx") * 0.5 + 10).alias("lon"), "zone")
    back = spatial.within(points, edges).join(shapes.select(F.col("region").alias("zone_id"), F.col("zone").alias("found")), "zone_id").join(points, "loc_id")
    rows = back.select("loc_id", "zone", "found").collect()
    assert len(rows) == (zones >= 0).sum() and all(r["zone"] == r["found"] for r in rows)
    for r in shapes.collect():
        areas = [regions.area(np.array([(p["x"], p["y"]) for p in ring])) for ring in r["rings"]]
        assert areas[0] > 0 and all(a < 0 for a in areas[1:]) and sum(areas) / 2 / 0.25 == pytest.approx(r["cells"])
    shapes.unpersist()


def test_holes_are_rings(spark):
    shapes = {r["zone"]: r["rings"] for r in regions.polygons(raster(spark, np.array([[1, 1, 1, 1], [1, 2, 2, 1], [1, 1, 1, 1]])), tile=2).collect()}
    assert [len(r) for r in shapes[1]] == [4, 4] and [len(r) for r in shapes[2]] == [4]
    assert {(p["x"], p["y"]) for p in shapes[1][1]} == {(p["x"], p["y"]) for p in shapes[2][0]} == {(0.5, 0.5), (2.5, 0.5), (2.5, 1.5), (0.5, 1.5)}


def test_a_zone_of_many_parts(spark):
    shapes = regions.polygons(raster(spark, np.array([[1, 0, 1], [0, 0, 0], [1, 0, 1]])), tile=2)
    maps = {r["zone"]: r for r in regions.zone_maps(shapes).withColumn("geometry", regions.multipolygon()).collect()}
    assert len(maps[1]["parts"]) == 4 and len(maps[0]["parts"]) == 1
    assert maps[1]["geometry"].startswith('{"type":"MultiPolygon","coordinates":[[[[-0.5,-0.5],[0.5,-0.5],[0.5,0.5],[-0.5,0.5],[-0.5,-0.5]]]')
    assert regions.polygons(raster(spark, np.array([[-1]])), tile=2).count() == 0


@pytest.mark.parametrize("radius", [1.0, 2.0, 2.5])
def test_smoothing_equals_a_disc(spark, radius):
    zones = np.random.default_rng(5).choice([0, 1, 2], (19, 23), p=[0.2, 0.5, 0.3])
    got = {(r["row_idx"], r["col_idx"], r["zone"]) for r in regions.smooth(raster(spark, zones), radius, tile=6).collect()}
    n = int(radius) + 3
    disc = [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if a * a + b * b <= radius * radius]
    expected = set()
    for zone in (0, 1, 2):
        own = {tuple(x) for x in np.argwhere(zones == zone).tolist()}
        grown = {(y + a, x + b) for y, x in own for a, b in disc}
        expected |= {(y, x, zone) for y, x in grown if all((y + a, x + b) in grown for a, b in disc)}
    assert got == expected


def test_filled_polygons_are_their_cells(spark):
    cells = raster(spark, RASTERS["holes"], (4, -2))
    back = regions.filled(regions.polygons(cells, tile=5, min_x=1.0, min_y=2.0, step=0.5), 1.0, 2.0, 0.5)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))


def test_a_map_of_zones(spark):
    """Islands go and their places are filled; narrow gaps are closed by smoothing; a base map cuts the rest off."""
    zones = np.ones((12, 24), int)
    zones[:, 12:] = 2
    zones[4:6, 4:6] = 2  # an island within the first zone
    zones[0, 18:20] = 1  # at the border: not within the second zone's outline
    area = lambda rings: sum(regions.area(np.array([(p["x"], p["y"]) for p in r])) for r in rings) / 2
    cells = raster(spark, zones)
    plain = {r["zone"]: r["rings"] for r in wf.zone_map(cells).collect()}
    assert area(plain[1]) == 12 * 12 + 2 and area(plain[2]) == 12 * 12 - 2 and len(plain[1]) == 2
    smooth = {r["zone"]: r["rings"] for r in wf.zone_map(cells, smoothing=2.0).collect()}
    assert area(smooth[1]) == area(plain[1]) and area(smooth[2]) >= area(plain[2])
    base = spark.createDataFrame([("land", [[{"x": x, "y": y} for x, y in ((6.5, 2.5), (14.5, 2.5), (14.5, 8.5), (6.5, 8.5))]])], "zone_id string, rings array<array<struct<x: double, y: double>>>")
    cut = {(r["zone"], r["zone_id"]): area(r["rings"]) for r in wf.zone_map(cells, base=base).collect()}
    assert cut == pytest.approx({(1, "land"): 5 * 6, (2, "land"): 3 * 6})


def test_many_regions_share_a_group(spark, monkeypatch):
    """Regions of one cell each: groups in Python follow the sides, not the regions."""
    monkeypatch.setattr(regions, "LINES", 400)
    cells = spark.range(900).selectExpr("id div 30 as row_idx", "id % 30 as col_idx", "(id div 30 + id) % 2 as zone")
    made = regions.polygons(cells)
    assert made.filter("cells = 1 and size(rings) = 1 and size(rings[0]) = 4").count() == 900
    plan = made._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandas [_g#" in plan and "FlatMapGroupsInPandas [region#" not in plan
