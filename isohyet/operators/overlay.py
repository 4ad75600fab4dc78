"""Polygons cut by polygons: the parts that two maps have in common.

Edges of both maps meet by an equi-join on tiles and are cut where they cross, touch or run together. Of what is left of
an edge, its middle tells whether it lies inside the other polygon; pieces of the border in common are kept once where
both interiors lie on the same side. These pieces, joined end to end, are the rings of the common part. Only the rings of
one common part meet in a task.

Coordinates are rounded to PLACES decimals, so that what meets in one point has one point. A polygon's rings may run
either way: a ring within an odd number of the polygon's others is a hole.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.operators import lineage
from isohyet.operators.spatial import _tile, level_of, within

PLACES = 9
POINTS = "array<struct<x: double, y: double>>"


def ring_edges(maps: DataFrame, zone: str = "zone_id", rings: str = "rings") -> DataFrame:
    """(zone_id, ring, x1, y1, x2, y2) of the rings' edges, each with the interior on its left."""
    ring = maps.select(F.col(zone).alias("zone_id"), F.posexplode(rings).alias("ring", "r"))
    point = F.transform("r", lambda p: F.struct(F.round(p["x"], PLACES).alias("x"), F.round(p["y"], PLACES).alias("y")))
    ring = ring.withColumn("r", point)
    ring = ring.withColumn("r", F.when(F.element_at("r", 1) == F.element_at("r", -1), F.slice("r", F.lit(1), F.size("r") - 1)).otherwise(F.col("r"))).filter(F.size("r") > 2)
    ahead = F.concat(F.slice("r", F.lit(2), F.size("r") - 1), F.slice("r", F.lit(1), F.lit(1)))
    pairs = F.filter(F.arrays_zip(F.col("r").alias("p"), ahead.alias("q")), lambda e: e["p"] != e["q"])
    area = F.aggregate(pairs, F.lit(0.0), lambda s, e: s + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])
    sized = ring.select("zone_id", "ring", pairs.alias("_e"), area.alias("_area")).filter("_area <> 0")
    flat = sized.select("zone_id", "ring", "_area", F.explode("_e").alias("e")).select(
        "zone_id", "ring", "_area", F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2")
    )
    # How many other rings of its polygon a ring lies in; it doesn't cross them, so the middle of one edge tells.
    named = flat.withColumn("_id", F.struct("zone_id", "ring"))
    middle = named.groupBy("_id").agg(F.min(F.struct(((F.col("x1") + F.col("x2")) / 2).alias("lon"), ((F.col("y1") + F.col("y2")) / 2).alias("lat"))).alias("m"))
    several = named.groupBy("zone_id").agg(F.max("ring").alias("_most")).filter("_most > 0").select("zone_id")
    held = within(middle.select(F.col("_id").alias("loc_id"), "m.lon", "m.lat").join(several, F.col("loc_id.zone_id") == F.col("zone_id"), "left_semi"), named.select(F.col("_id").alias("zone_id"), "x1", "y1", "x2", "y2"))
    depth = held.filter((F.col("loc_id.zone_id") == F.col("zone_id.zone_id")) & (F.col("loc_id.ring") != F.col("zone_id.ring"))).groupBy("loc_id").agg(F.count(F.lit(1)).alias("_depth"))
    told = flat.join(depth.select("loc_id.zone_id", "loc_id.ring", "_depth"), ["zone_id", "ring"], "left")
    hole = F.coalesce("_depth", F.lit(0)) % 2 == 1
    turned = (F.col("_area") > 0) == hole
    ends = {"x1": "x2", "y1": "y2", "x2": "x1", "y2": "y1"}
    return told.select("zone_id", "ring", *(F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in ends.items()))


def _tiled(edges: DataFrame, levels: DataFrame, own: bool) -> DataFrame:
    """Edges in the tiles of their own side, or of every larger side in use: at most four of each."""
    out = edges.withColumn("_own", level_of(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))), F.lit(1)))
    out = out.withColumn("_level", F.col("_own")) if own else out.join(F.broadcast(levels), F.col("_level") >= F.col("_own"))
    for c, t in (("x", "_tx"), ("y", "_ty")):
        out = out.withColumn(t, F.explode(F.sequence(*(_tile(f(f"{c}1", f"{c}2"), F.col("_level")) for f in (F.least, F.greatest)))))
    return out


def crossings(a: DataFrame, b: DataFrame, along_only: bool = False) -> DataFrame:
    """(a_edge, b_edge, x, y): points that edges of a and b - named by `edge` - have in common, the ends of shared
    stretches among them, or the latter alone."""
    levels = lambda df: _tiled(df, df, own=True).select("_level").distinct()
    tile = ["_level", "_tx", "_ty"]

    def met(one: DataFrame, p: str, two: DataFrame, q: str, equal: bool) -> DataFrame:
        large, small = _tiled(one, one, own=True), _tiled(two, levels(one), own=False)
        small = small if equal else small.filter("_level > _own")
        keep = lambda df, p: df.select(*(F.col(c).alias(p + c) for c in ("edge", "x1", "y1", "x2", "y2")), *tile)
        return keep(large, p).join(keep(small, q), tile)

    columns = [p + c for p in ("a_", "b_") for c in ("edge", "x1", "y1", "x2", "y2")]
    pairs = met(a, "a_", b, "b_", True).select(*columns).unionByName(met(b, "b_", a, "a_", False).select(*columns)).distinct()
    px, py, rx, ry = F.col("a_x1"), F.col("a_y1"), F.col("b_x1"), F.col("b_y1")
    dx, dy, ex, ey = F.col("a_x2") - px, F.col("a_y2") - py, F.col("b_x2") - rx, F.col("b_y2") - ry
    turn = dx * ey - dy * ex
    t, u = ((rx - px) * ey - (ry - py) * ex) / F.nullif(turn, F.lit(0.0)), ((rx - px) * dy - (ry - py) * dx) / F.nullif(turn, F.lit(0.0))
    at = lambda x, y: F.struct(F.round(x, PLACES).alias("x"), F.round(y, PLACES).alias("y"))
    slack = 10.0**-PLACES
    size = F.greatest(F.abs(dx), F.abs(dy))
    near = lambda v, n: (v >= -slack / n) & (v <= 1 + slack / n)
    crossing = near(t, size) & near(u, F.greatest(F.abs(ex), F.abs(ey)))
    # Along one line: the ends of either that lie within the other.
    aligned = (turn == 0) & (F.abs((rx - px) * dy - (ry - py) * dx) <= slack * size)
    along = lambda x, y, ox, oy, vx, vy: ((x - ox) * vx + (y - oy) * vy).between(F.lit(0.0), vx * vx + vy * vy)
    ends = [F.when(along(x, y, px, py, dx, dy), at(x, y)) for x, y in ((rx, ry), (F.col("b_x2"), F.col("b_y2")))]
    ends += [F.when(along(x, y, rx, ry, ex, ey), at(x, y)) for x, y in ((px, py), (F.col("a_x2"), F.col("a_y2")))]
    points = F.when(aligned, F.filter(F.array(*ends), lambda p: p.isNotNull())).when(crossing & F.lit(not along_only), F.array(at(px + t * dx, py + t * dy)))
    return pairs.select("a_edge", "b_edge", F.explode(points).alias("p")).select("a_edge", "b_edge", "p.x", "p.y")


def split(edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """(zone_id, x1, y1, x2, y2) of the edges cut at the points (edge, x, y)."""
    points = cuts.groupBy("edge").agg(F.collect_set(F.struct("x", "y")).alias("_p"))
    held = edges.join(points, "edge", "left")
    first, last = (F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    every = F.array_distinct(F.concat(F.array(first, last), F.coalesce("_p", F.array().cast(POINTS))))
    order = F.array_sort(F.transform(every, lambda p: F.struct(((p["x"] - F.col("x1")) * dx + (p["y"] - F.col("y1")) * dy).alias("t"), p["x"].alias("x"), p["y"].alias("y"))))
    pairs = F.arrays_zip(F.slice(order, F.lit(1), F.size(order) - 1).alias("p"), F.slice(order, F.lit(2), F.size(order) - 1).alias("q"))
    return held.select("zone_id", F.explode(pairs).alias("e")).select("zone_id", F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))


def stitched(edges: list[tuple[float, float, float, float]]) -> list[list[dict[str, float]]]:
    """Rings of directed edges with the interior on their left: at a corner where several leave, the leftmost is taken, so
    that parts that touch in a point stay apart. Corners on a straight line are left out."""
    leaving: dict[tuple[float, float], list[int]] = {}
    for i, e in enumerate(edges):
        leaving.setdefault(e[:2], []).append(i)
    angle = lambda e: math.atan2(e[3] - e[1], e[2] - e[0])
    used, rings = [False] * len(edges), []
    for first in range(len(edges)):
        ring, at = [], first
        while not used[at]:
            used[at] = True
            ring.append(edges[at][:2])
            ways = [i for i in leaving.get(edges[at][2:], []) if not used[i] or i == first]
            if not ways:
                ring = []
                break
            back = angle(edges[at]) + math.pi
            at = min(ways, key=lambda i: (back - angle(edges[i]) - 1e-12) % (2 * math.pi))  # noqa: B023
        bent = [p for o, p, q in zip(ring[-1:] + ring[:-1], ring, ring[1:] + ring[:1], strict=True) if abs((p[0] - o[0]) * (q[1] - p[1]) - (p[1] - o[1]) * (q[0] - p[0])) > 10.0 ** (-2 * PLACES)]
        if len(bent) > 2:
            rings.append([{"x": x, "y": y} for x, y in bent])
    return rings


def intersection(a: DataFrame, b: DataFrame, zone: str = "zone_id", rings: str = "rings") -> DataFrame:
    """(a_id, b_id, rings) of the common part of every two polygons of maps a and b (zone, rings) that have one: outer rings
    run counter-clockwise, holes clockwise."""
    numbered = {n: lineage.cut(ring_edges(df, zone, rings).withColumn("edge", F.struct("zone_id", "ring", "x1", "y1", "x2", "y2"))) for n, df in (("a", a), ("b", b))}
    cut = numbered
    # What others cut into one of two edges that run together is cut into the other by the second round, so that both are
    # in the same pieces.
    for along_only in (False, True):
        met = lineage.cut(crossings(cut["a"], cut["b"], along_only))
        pieces = {n: split(cut[n], met.select(F.col(f"{n}_edge").alias("edge"), "x", "y").distinct()) for n in ("a", "b")}
        cut = {n: lineage.cut(p.withColumn("edge", F.struct("zone_id", "x1", "y1", "x2", "y2"))) for n, p in pieces.items()}
    first, last = (F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2))
    ends = [F.least(first, last).alias("_low"), F.greatest(first, last).alias("_high")]
    common = cut["a"].select(F.col("zone_id").alias("a_id"), "x1", "y1", "x2", "y2", *ends).join(cut["b"].select(F.col("zone_id").alias("b_id"), F.col("x1").alias("_bx"), F.col("y1").alias("_by"), *ends), ["_low", "_high"])
    kept = common.filter((F.col("x1") == F.col("_bx")) & (F.col("y1") == F.col("_by"))).select("a_id", "b_id", "x1", "y1", "x2", "y2")
    for n, other in (("a", "b"), ("b", "a")):
        middle = cut[n].select(F.struct("zone_id", "x1", "y1", "x2", "y2").alias("loc_id"), ((F.col("x1") + F.col("x2")) / 2).alias("lon"), ((F.col("y1") + F.col("y2")) / 2).alias("lat"))
        inside = within(middle, numbered[other]).select(F.col("loc_id.zone_id").alias(f"{n}_id"), F.col("zone_id").alias(f"{other}_id"), *(F.col(f"loc_id.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))
        shared = common.select("a_id", "b_id", "_low", "_high")
        own = inside.select("a_id", "b_id", "x1", "y1", "x2", "y2", *ends).join(shared, ["a_id", "b_id", "_low", "_high"], "left_anti")
        kept = kept.unionByName(own.select("a_id", "b_id", "x1", "y1", "x2", "y2"))

    def traced(f: pd.DataFrame) -> pd.DataFrame:
        found = stitched(sorted(f[["x1", "y1", "x2", "y2"]].itertuples(index=False, name=None)))
        return pd.DataFrame({"a_id": f["a_id"].iloc[:1], "b_id": f["b_id"].iloc[:1], "rings": [found]}) if found else pd.DataFrame({"a_id": [], "b_id": [], "rings": []}, dtype=object)

    kinds = dict(a.dtypes)[zone], dict(b.dtypes)[zone]
    return kept.distinct().groupBy("a_id", "b_id").applyInPandas(traced, f"a_id {kinds[0]}, b_id {kinds[1]}, rings array<{POINTS}>")


def ring_area(ring: Column) -> Column:
    """Signed area of a ring of points (x, y): positive where it runs counter-clockwise."""
    ahead = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, F.lit(1), F.lit(1)))
    return F.aggregate(F.arrays_zip(ring.alias("p"), ahead.alias("q")), F.lit(0.0), lambda s, e: s + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]) / 2
