"""Radial bases by blocks of stations, against the equations solved at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.operators import lineage, models, radial, spatial

SMALL = {"domain": 32, "around": 32, "coarse": 40, "group": 70, "tolerance": 1e-8}


def stations_of(spark, rows):
    return spark.createDataFrame([(float(x), float(y), None if v is None else float(v)) for x, y, v in rows], "lon double, lat double, value double")


def plain(x, y, v, at):
    w = np.linalg.solve(np.hypot(x[:, None] - x, y[:, None] - y), v)
    return np.hypot(at[:, :1] - x, at[:, 1:] - y) @ w


def test_blocks_equal_the_direct_solution(spark):
    rng = np.random.default_rng(11)
    p = rng.uniform(0, 20, (160, 2))
    v = np.sin(p[:, 0]) + p[:, 1]
    twice = [(p[0, 0], p[0, 1], v[0] + 1), (p[0, 0], p[0, 1], v[0] - 1)]  # at one place, whose mean is the same
    rows = [*np.column_stack([p, v]).tolist(), *twice, (1.0, 1.0, None)]
    grid = spatial.mesh(spark, 0, 20, 0, 20, 4.0)
    got = models.rbf(grid, stations_of(spark, rows), ["row_idx", "col_idx"], most=10, **SMALL).collect()
    at = np.array([(r["col_idx"] * 4.0, r["row_idx"] * 4.0) for r in got])
    assert len(got) == 36 and [r["value"] for r in got] == pytest.approx(plain(p[:, 0], p[:, 1], v, at).tolist(), abs=1e-4)


def test_few_stations(spark):
    grid = spatial.mesh(spark, 0, 1, 0, 1, 1.0)
    for rows, want in (([], 0.0), ([(0, 0, 3)], 0.0), ([(0, 0, None), (1, 1, float("nan"))], 0.0)):
        assert {r["value"] for r in models.rbf(grid, stations_of(spark, rows), ["row_idx", "col_idx"]).collect()} == {want}
    two = {(r["row_idx"], r["col_idx"]): r["value"] for r in models.rbf(grid, stations_of(spark, [(0, 0, 1), (1, 1, 5)]), ["row_idx", "col_idx"]).collect()}
    assert two[0, 0] == pytest.approx(1) and two[1, 1] == pytest.approx(5)
    flat = stations_of(spark, [(i, i % 3, 0) for i in range(12)])
    assert {r["value"] for r in models.rbf(grid, flat, ["row_idx", "col_idx"], most=10).collect()} == {0.0}


def test_sums_of_distances_by_any_number_of_blocks(spark):
    rng = np.random.default_rng(12)
    s, t = rng.uniform(0, 9, (70, 3)), rng.uniform(0, 9, (30, 2))
    sources = spark.createDataFrame(s.tolist(), "lon double, lat double, w double")
    targets = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(t)], "w long, lon double, lat double")
    want = np.hypot(t[:, :1] - s[:, 0], t[:, 1:] - s[:, 1]) @ s[:, 2]
    for groups in ((1, 1), (3, 5), (9, 14)):
        got = {r["w"]: r["value"] for r in radial.distance_sums(targets, sources, ["w"], *groups).collect()}
        assert [got[i] for i in range(30)] == pytest.approx(want.tolist())


def test_each_station_has_one_domain(spark):
    rng = np.random.default_rng(13)
    known = stations_of(spark, np.column_stack([rng.uniform(0, 5, (300, 2)), np.ones(300)]).tolist())
    points = radial._numbered(known, 300, 20)
    assert points.select("id").distinct().count() == 300 and max(r["count"] for r in points.groupBy("dom").count().collect()) <= 20
    members = radial._members(points, 7)
    assert members.groupBy("dom", "id").count().filter("count > 1").isEmpty()
    assert members.filter("own").count() == 300 and max(r["count"] for r in members.filter("not own").groupBy("dom").count().collect()) <= 7


def test_blocks_meet_few_others(spark):
    """Sums are those of all pairs, clusters too, while a block meets few others one by one, however many there are."""
    rng = np.random.default_rng(14)
    met = []
    for n in (6400, 12800):
        p = rng.uniform(0, 20, (n, 2))
        p[: n // 4] = 3 + p[: n // 4] / 1000
        w = rng.normal(size=n)
        sources = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(p, w, strict=True))], "id long, lon double, lat double, w double")
        blocks = radial._blocked(sources, n // 50)
        sums = radial.Sums(blocks, blocks)
        met.append(sums.close.count() / len(sums.blocks))
        got = {r["id"]: r["value"] for r in sums.of(blocks, ["id"]).collect()}
        want = np.concatenate([np.hypot(q[:, :1] - p[:, 0], q[:, 1:] - p[:, 1]) @ w for q in np.split(p, 16)])
        assert [got[i] for i in range(n)] == pytest.approx(want.tolist(), abs=1e-8)
    assert met[1] < 1.4 * met[0] < 40  # twice as many if all met


def test_rounds_of_joins_keep_a_plain_size(spark):
    state = spark.range(5).withColumn("v", F.lit(1.0))
    for _ in range(6):
        state = lineage.cut(state.join(lineage.cut(state.select("id", F.col("v").alias("a"))), "id").select("id", (F.col("v") + F.col("a")).alias("v")))
    assert len(str(state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 20
    assert {r["v"] for r in state.collect()} == {64.0}


def test_sums_nearby_grow_with_the_places(monkeypatch):
    """The same sums as one by one, clusters and lines too, from far fewer distances than there are pairs."""
    rng, plain_sums, pairs = np.random.default_rng(15), radial._summed, []
    monkeypatch.setattr(radial, "_summed", lambda ax, ay, bx, by, w: (pairs.append(len(ax) * len(bx)), plain_sums(ax, ay, bx, by, w))[1])
    for shape in ("even", "cluster", "line"):
        took = []
        for n in (2048, 8192):
            a, b = rng.uniform(2, 3, (n, 2)), rng.uniform(1, 4, (9 * n, 2))
            if shape == "cluster":
                a[: n // 2] = 2.5 + a[: n // 2] / 10_000
                b[: n // 2] = a[: n // 2]
            if shape == "line":
                a[:, 1] = b[:, 1] = 0.0
            w = rng.normal(size=len(b))
            pairs.clear()
            got = radial._fast_sums(*a.T, *b.T, w)
            took.append(sum(pairs))
            some = rng.integers(0, n, 50)
            assert got[some] == pytest.approx(plain_sums(*a[some].T, *b.T, w), abs=1e-8)
        assert took[1] < 8 * took[0] and took[1] < 8192 * 9 * 8192 / 10  # pairs are 16 times as many


@pytest.mark.parametrize("shape", ["even", "line", "cluster"])
def test_restarts_reproduce_the_values(spark, shape):
    rng = np.random.default_rng(16)
    p = rng.uniform(0, 20, (300, 2))
    if shape == "line":
        p[:, 1] = 3.0
    if shape == "cluster":
        p[:100] = 5 + p[:100] / 1000
    v = rng.normal(size=300)
    known = radial.places(stations_of(spark, np.column_stack([p, v]).tolist()))
    rows = radial.weights(known, 300, domain=16, around=16, coarse=20, group=40, tolerance=1e-9, steps=6).collect()
    x, y, w = np.array([tuple(r) for r in rows]).T
    assert len(rows) == 300 and np.hypot(p[:, :1] - x, p[:, 1:] - y) @ w == pytest.approx(v, abs=1e-5)


def test_coarse_places_are_spread_evenly():
    x, y = np.random.default_rng(17).uniform(0, 1, (2, 3000))
    at = radial._spread(x, y, 100)
    assert len(set(at.tolist())) == 100
    assert {(int(a * 4), int(b * 4)) for a, b in zip(x[at], y[at], strict=True)} == {(i, j) for i in range(4) for j in range(4)}
    assert len(radial._spread(x[:5], y[:5], 9)) == 5 and len(radial._spread(x, y, 0)) == 0
