"""Grants of sharding, and groups that stay together on full shards."""

from collections import Counter, defaultdict

import numpy as np

from isohyet.llm import sharding


def test_grants_leave_no_ask_that_could_be_granted():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 24):
        for _ in range(20):
            asks = rng.integers(0, 50, (n, n)) * (rng.random((n, n)) < 0.4)
            np.fill_diagonal(asks, 0)
            room = rng.integers(-3, 20, n) * (rng.random(n) < 0.5)
            got = sharding.grants(asks, room)
            gained = got.sum(axis=0) - got.sum(axis=1)
            assert (got >= 0).all() and (got <= asks).all() and (gained <= np.maximum(room, 0)).all()
            left, free = asks - got, np.maximum(room, 0) - gained
            assert not sharding._ring(left) and not (left[:, free > 0]).any()
    asks = np.zeros((3, 3), int)
    asks[0, 1], asks[1, 2], asks[2, 0] = 4, 5, 6
    assert sharding.grants(asks, np.zeros(3, int)).tolist() == [[0, 4, 0], [0, 0, 4], [4, 0, 0]]


def test_groups_end_on_one_shard(spark):
    # Pairs, a group that fills half of a shard, and single rows: all links can be kept.
    texts = [f"pair {i // 2}" for i in range(2000)] + ["same"] * 120 + [f"single {i}" for i in range(3880)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard(df).collect()
    where = defaultdict(list)
    for r in rows:
        where[texts[r["doc_id"]]].append(r["shard"])
    assert set(Counter(r["shard"] for r in rows).values()) == {250}
    assert all(len(set(g)) == 1 for g in where.values())
    # Without single rows, rows move against each other only.
    df = spark.createDataFrame([(i, f"pair {i // 2}") for i in range(2400)], "doc_id long, text string")
    named = sharding.named(df)
    links = sharding.written(sharding.links_of_equal_texts(named), "links")
    placed = sharding.written(sharding.even(sharding.propagate(named, links), links.selectExpr("src as row")), "placed")
    cut, n = sharding.cut_links(links, placed)
    assert n == 1200 and cut <= 120
    assert set(Counter(r["shard"] for r in placed.collect()).values()) == {100}
