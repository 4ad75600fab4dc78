"""Centroid clustering against plain loops in whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from isohyet.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def plain(rows, k=16, rounds=3, width=64, scale=64, seed=1):
    """(vec_id, cluster, distance) of every kept row, and the final centroids."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) and abs(x * scale) < centroids.limit(width) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    at = [v for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [[] for _ in at]
        for _, v in kept:
            own[near(v)[1]].append(v)
        at = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else c for o, c in zip(own, at, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], at


def compare(df, rows, **options):
    got = df.collect()
    want, at = plain(rows, **options)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in got) == sorted((str(i), j, d) for i, j, d in want)
    inertia = {j: sum(d for _, c, d in want if c == j) for _, j, _ in want}
    for r in got:
        assert r["cluster_inertia"] == inertia[r["cluster"]] and r["inertia"] == sum(inertia.values()) and r["centroid"] == at[r["cluster"]]


def vectors(n, width, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, width)) * 3
    return (middles[rng.integers(0, 5, n)] + rng.normal(size=(n, width)) * spread).astype(np.float32)


@pytest.mark.parametrize("width,spread", [(2, 0.3), (64, 0.1), (64, 2.0)])
def test_equals_plain_loops(spark, width, spread):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(700, width, 1, spread))]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    compare(centroids.cluster(df, width=width), rows, width=width)


def test_ties_and_copies(spark):
    """A hot vector, points half-way between centroids, and more centroids than places."""
    rows = [(i, [1.0, 1.0]) for i in range(300)] + [(300 + i, [float(i % 3), float(i % 2)]) for i in range(60)] + [(300, [0.0, 0.0])] * 4
    compare(centroids.cluster(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5), width=2, scale=2), rows, width=2, scale=2)


def test_awkward_rows(spark):
    good = vectors(40, 64, 2).tolist()
    rows = [(i, v) for i, v in enumerate(good)] + [(100, None), (101, []), (102, good[0][:63]), (103, good[0] + [0.0]), (104, [*good[0][:63], None]), (105, [*good[0][:63], math.nan]), (106, [*good[0][:63], math.inf]), (107, [*good[0][:63], 1e30]), (None, good[1]), (None, good[2]), (3, good[4]), (3, good[4])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    compare(centroids.cluster(df), rows)
    compare(centroids.cluster(df.limit(5)), rows[:5])
    assert centroids.cluster(df.filter("vec_id >= 100")).collect() == [] and centroids.cluster(df.limit(0)).collect() == []


def test_large_components_are_exact(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(4).integers(-(1 << 19), 1 << 19, (200, 64)))]
    compare(centroids.cluster(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)), rows)


@pytest.mark.parametrize("leaf_rows", [1, 7, 1000])
def test_trees_hold_what_is_below(leaf_rows):
    v = np.random.default_rng(3).integers(-50, 50, (333, 2)).astype(np.int32)
    order, tree = centroids.build(v, leaf_rows)
    assert sorted(order.tolist()) == list(range(333)) and np.array_equal(v[order], tree.vectors)
    for i, (a, b) in enumerate(zip(tree.starts, tree.ends, strict=True)):
        own = tree.vectors[a:b]
        assert np.array_equal(own.min(0), tree.low[i]) and np.array_equal(own.max(0), tree.high[i]) and np.array_equal(own.sum(0), tree.sums[i])
        assert tree.child[i] >= 0 or b - a <= leaf_rows
    at = np.random.default_rng(5).integers(-50, 50, (9, 2))
    seen = np.full(333, -1)
    whole = 0
    for node, j, each in centroids.assign(tree, at):
        rows = slice(tree.starts[node], tree.ends[node])
        assert (seen[rows] == -1).all()
        seen[rows] = j if each is None else each
        whole += each is None and tree.child[node] >= 0
    far = ((tree.vectors[:, None, :].astype(np.int64) - at) ** 2).sum(2)
    assert np.array_equal(seen, far.argmin(1)) and (whole > 0 or leaf_rows == 1000)


def test_op13_equals_plain_loops(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, at = plain(rows)
    inertia = {j: sum(d for _, c, d in want if c == j) for _, j, _ in want}
    got = {r["vec_id"]: tuple(r)[1:] for r in queries.op13_centroids(spark, sf_dir).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    assert got == {i: (j, d, inertia[j], sum(inertia.values()), digest[j]) for i, j, d in want}
