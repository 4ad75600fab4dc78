"""Common parts of polygons against a fine raster and against known shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.operators import overlay

SQUARE = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
SCHEMA = "zone_id string, rings array<array<struct<x: double, y: double>>>"


def maps(spark, shapes):
    return spark.createDataFrame([(n, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for n, rings in shapes.items()], SCHEMA)


def areas(df):
    total = F.aggregate(F.transform("rings", overlay.ring_area), F.lit(0.0), lambda s, v: s + v)
    return {(r["a_id"], r["b_id"]): (r["area"], r["n"]) for r in df.select("a_id", "b_id", total.alias("area"), F.size("rings").alias("n")).collect()}


def inside(rings, x, y):
    odd = np.zeros(len(x), bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if y1 != y2:
                odd ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return odd


A = {
    "plain": [SQUARE(0, 0, 4)],
    "ringed": [SQUARE(10, 0, 8), SQUARE(12, 2, 4)[::-1]],
    "turned": [SQUARE(10, 20, 8)[::-1], SQUARE(12, 22, 4)[::-1]],  # holes and outlines may run either way
    "L": [[(30, 0), (40, 0), (40, 2), (32, 2), (32, 10), (30, 10)]],
    "touching": [[(50, 0), (52, 2), (54, 0), (54, 4), (52, 2), (50, 4)]],
}
CASES = {
    "same": ({"plain": A["plain"]}, {"b": A["plain"]}, {("plain", "b"): (16, 1)}),
    "beside, one side in common": ({"plain": A["plain"]}, {"b": [SQUARE(4, 0, 4)]}, {}),
    "corner only": ({"plain": A["plain"]}, {"b": [SQUARE(4, 4, 4)]}, {}),
    "within, flush": ({"plain": A["plain"]}, {"b": [SQUARE(0, 0, 2)]}, {("plain", "b"): (4, 1)}),
    "half a side in common": ({"plain": A["plain"]}, {"b": [[(2, 1), (6, 1), (6, 3), (2, 3)]]}, {("plain", "b"): (4, 1)}),
    "corner on a side": ({"plain": A["plain"]}, {"b": [[(4, 2), (2, 4), (0, 2), (2, 0)]]}, {("plain", "b"): (8, 1)}),
    "around the hole": ({"r": A["ringed"]}, {"b": [SQUARE(11, 1, 6)]}, {("r", "b"): (20, 2)}),
    "over the hole": ({"r": A["ringed"]}, {"b": [SQUARE(13, 3, 2)]}, {}),
    "the hole itself": ({"r": A["ringed"]}, {"b": [SQUARE(12, 2, 4)]}, {}),
    "through the hole": ({"r": A["ringed"]}, {"b": [[(9, 3), (20, 3), (20, 5), (9, 5)]]}, {("r", "b"): (8, 2)}),
    "either way": ({"t": A["turned"]}, {"b": [SQUARE(9, 19, 12)]}, {("t", "b"): (48, 2)}),
    "two parts": ({"L": A["L"]}, {"b": [[(28, 12), (42, -2), (43, -1), (29, 13)]]}, None),
    "touching itself": ({"x": A["touching"]}, {"b": [SQUARE(49, -1, 6)]}, {("x", "b"): (8, None)}),
}


def test_cases(spark):
    """All cases on one pair of maps, far from each other."""
    both = ({}, {})
    for i, (a, b, _) in enumerate(CASES.values()):
        for held, own in zip(both, (a, b), strict=True):
            held |= {f"{i} {n}": [[(x + 1000 * i, y) for x, y in r] for r in rings] for n, rings in own.items()}
    got = areas(overlay.intersection(*(maps(spark, m) for m in both)))
    for i, (name, (_, _, expected)) in enumerate(CASES.items()):
        own = {tuple(x.split(" ", 1)[1] for x in k): v for k, v in got.items() if k[0].split(" ")[0] == str(i)}
        if expected is None:
            assert [n for _, n in own.values()] == [2], name
            continue
        assert set(own) == set(expected), name
        for key, (area, n) in expected.items():
            assert own[key][0] == pytest.approx(area) and (n is None or own[key][1] == n), name


def test_areas_equal_a_fine_raster(spark):
    rng = np.random.default_rng(4)

    def star(cx, cy, r, n):
        return [(cx + s * np.cos(t), cy + s * np.sin(t)) for t, s in zip(np.linspace(0, 2 * np.pi, n, endpoint=False), r * rng.uniform(0.4, 1, n), strict=True)]

    a = {f"a{i}": [star(*rng.uniform(0, 10, 2), rng.uniform(1, 5), int(rng.integers(5, 30)))] for i in range(5)}
    b = {f"b{i}": [star(*rng.uniform(0, 10, 2), rng.uniform(1, 5), int(rng.integers(5, 30)))] for i in range(4)}
    step = 0.02
    y, x = (v.ravel() for v in np.mgrid[-5:15:step, -5:15:step])
    expected = {(n, m): (inside(p, x, y) & inside(q, x, y)).sum() * step * step for n, p in a.items() for m, q in b.items()}
    got = areas(overlay.intersection(maps(spark, a), maps(spark, b)))
    assert {k for k, v in expected.items() if v > 0.05} <= set(got)
    for key, (area, _) in got.items():
        assert area == pytest.approx(expected[key], abs=0.15)


def test_pieces_of_shared_sides_are_cut_alike(spark):
    """Neighbours of both maps share lines, and end at different places along them."""
    a = {f"a{i}": [[(i, 0), (i + 1, 0), (i + 1, 2), (i, 2)]] for i in range(6)} | {"long": [[(0, 2), (6, 2), (6, 3), (0, 3)]]}
    b = {f"b{i}": [[(i * 0.75, 0), (i * 0.75 + 0.75, 0), (i * 0.75 + 0.75, 2), (i * 0.75, 2)]] for i in range(8)} | {"low": [[(0.5, 1), (5.25, 1), (5.25, 2), (0.5, 2)]], "high": [[(0.25, 2), (5.5, 2), (5.5, 2.5), (0.25, 2.5)]]}
    box = lambda r: (r[0][0][0], r[0][0][1], r[0][2][0], r[0][2][1])
    expected = {}
    for n, p in a.items():
        for m, q in b.items():
            (x0, y0, x1, y1), (u0, v0, u1, v1) = box(p), box(q)
            w, h = min(x1, u1) - max(x0, u0), min(y1, v1) - max(y0, v0)
            if w > 0 and h > 0:
                expected[n, m] = w * h
    assert {k: v[0] for k, v in areas(overlay.intersection(maps(spark, a), maps(spark, b))).items()} == pytest.approx(expected)


def test_a_map_cut_by_itself_and_by_nothing(spark):
    a = maps(spark, A)
    assert {k: v[0] for k, v in areas(overlay.intersection(a, a)).items()} == pytest.approx({("plain", "plain"): 16, ("ringed", "ringed"): 48, ("turned", "turned"): 48, ("L", "L"): 36, ("touching", "touching"): 8})
    assert overlay.intersection(a, a.limit(0)).count() == 0
