"""Spatial joins: true containment, and joins whose rows grow with the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.operators import spatial

SHAPES = {
    "L": [(0, 0), (10, 0), (10, 2), (2, 2), (2, 10), (0, 10)],
    "beside": [(5, 5), (8, 5), (8, 8), (5, 8)],  # in the box of L, outside of it
    "in": [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)],
    "flush": [(0, 0), (2, 0), (2, 2), (0, 2)],  # sides and corners in common
    "over": [(1, 1), (3, 1), (3, 3), (1, 3)],  # crosses
    "bridge": [(1, 8), (8, 1), (9, 1), (1, 9)],  # corners in L, middle outside
    "wide": [(-1, -1), (11, -1), (11, 11), (-1, 11)],
    "comb": [(20, 0), (30, 0), (30, 10), (28, 10), (28, 1), (22, 1), (22, 10), (20, 10)],
    "bar": [(20, 8), (30, 8), (30, 9), (20, 9)],  # every corner on the comb's border, across its gap
}


def tables(spark, shapes):
    rows = [(n, [[{"x": float(x), "y": float(y)} for x, y in ring]]) for n, ring in shapes.items()]
    edges = spatial.edges_of_rings(spark.createDataFrame(rows, "zone_id string, rings array<array<struct<x: double, y: double>>>"))
    return spatial.boxes(edges).withColumnRenamed("zone_id", "poly_id"), edges


def test_containment_is_that_of_outlines(spark):
    polygons, edges = tables(spark, SHAPES)
    boxes = {(r[0], r[1]) for r in spatial.box_pairs(polygons).collect()}
    assert ("beside", "L") in boxes and ("bar", "comb") in boxes
    found = {(r[0], r[1]) for r in spatial.contained(spatial.box_pairs(polygons), edges).collect()}
    assert found == {("in", "L"), ("in", "flush"), ("flush", "L"), *((n, "wide") for n in ("L", "beside", "in", "flush", "over", "bridge"))}


def test_small_polygons_need_true_containment(spark):
    polygons, edges = tables(spark, {n: SHAPES[n] for n in ("L", "beside", "in")})
    zoned = polygons.withColumn("zone", F.lit(1))
    assert [r["poly_id"] for r in spatial.small_polygons(zoned, edges).collect()] == ["in"]
    assert spatial.small_polygons(zoned.limit(0), edges).count() == 0


def test_copies_of_an_outline_are_one_shape(spark, monkeypatch):
    """Copies lie within each other; pairs to be tested don't grow with them."""
    tested, contained = [], spatial.contained
    monkeypatch.setattr(spatial, "contained", lambda pairs, edges: tested.append(pairs.count()) or contained(pairs, edges))
    shapes = {f"{n}{i}": ring for n, ring in (("a", SHAPES["in"]), ("b", SHAPES["beside"]), ("c", SHAPES["L"])) for i in range(40)}
    polygons, edges = tables(spark, shapes | {"one": [(20, 20), (21, 20), (21, 21), (20, 21)]})
    found = spatial.small_polygons(polygons.withColumn("zone", F.lit(1)), edges)
    assert {r["poly_id"] for r in found.collect()} == {n for n in shapes if n[0] != "c"} and sum(tested) < 10


@pytest.mark.parametrize("large", [0, 20])
def test_join_rows_are_linear(spark, large):
    """Squares within one degree, and large ones over all of them: rows of the joins grow with the squares."""
    met = {}
    for n in (2500, 10000):
        side = int(n**0.5)
        k = F.col("id")
        x, y = (k % side) / side, F.floor(k / side) / side
        squares = spark.range(n).select(k.cast("string").alias("poly_id"), x.alias("min_x"), y.alias("min_y"), (x + 0.9 / side).alias("max_x"), (y + 0.9 / side).alias("max_y"))
        big = spark.range(large).select(F.concat(F.lit("big"), "id").alias("poly_id"), *(F.lit(v).alias(c) for c, v in (("min_x", -1.0), ("min_y", -1.0), ("max_x", 2.0), ("max_y", 2.0))))
        every = squares.unionByName(big)
        corners = F.array(*(F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y"))))
        edges = spatial.edges_of_rings(every.withColumn("rings", F.array(corners)), "poly_id")
        points = squares.select(F.col("poly_id").alias("loc_id"), ((F.col("min_x") + F.col("max_x")) / 2).alias("lon"), ((F.col("min_y") + F.col("max_y")) / 2).alias("lat"))
        met[n] = spatial.box_meetings(every).count(), spatial.meetings(points, edges).count()
        assert spatial.within(points, edges).count() == n * (1 + large)
    for few, many in zip(met[2500], met[10000], strict=True):
        assert many <= 4.5 * few and many <= 10000 * (10 + 1.2 * large)


def test_levels_follow_boxes_and_edges(spark):
    df = spark.createDataFrame([(0.0, 4), (1.0, 4), (100.0, 4), (100.0, 3200), (1e9, 4)], "extent double, n int")
    assert [r[0] for r in df.select(spatial.level_of(F.col("extent"), F.col("n"))).collect()] == [-24, 0, 7, 1, 10]


def test_points_by_brute_force(spark):
    rng = np.random.default_rng(11)
    shapes = {str(i): [(cx + r * np.cos(a) * s, cy + r * np.sin(a) * s) for a, s in zip(np.linspace(0, 2 * np.pi, n, endpoint=False), rng.uniform(0.4, 1, n), strict=True)] for i, (cx, cy, r, n) in enumerate(zip(rng.uniform(-50, 50, 12), rng.uniform(-50, 50, 12), 10 ** rng.uniform(-2, 2, 12), rng.integers(3, 200, 12), strict=True))}
    _, edges = tables(spark, shapes)
    points = [(str(i), float(y), float(x)) for i, (x, y) in enumerate(rng.uniform(-100, 100, (300, 2)))] + [(f"c{n}", float(np.mean([y for _, y in r])), float(np.mean([x for x, _ in r]))) for n, r in shapes.items()]

    def inside(ring, x, y):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    got = {(r["loc_id"], r["zone_id"]) for r in spatial.within(spark.createDataFrame(points, "loc_id string, lat double, lon double"), edges).collect()}
    assert got == {(p, n) for p, y, x in points for n, ring in shapes.items() if inside(ring, x, y)} and len(got) > 30
