"""Exact k-means over integer vectors by kd-tree filtering.

Vectors become integers, floor(scale * x), and each task puts those it reads into kd-trees, whose nodes hold the count
and sums of their vectors and the box around them. A round sends the centroids down every tree: a centroid is pruned
from a node where another is strictly nearer to the whole box, a node with one centroid left is assigned whole, and
the vectors of the leaves that remain are compared one by one. Only counts and sums of clusters leave a task, so a round
shuffles k rows a task. Trees are written once, into the shared folder.

All figures are integers, so results don't depend on the order of rows, tasks or sums. Equal distances go to the smaller
number; a centroid without vectors stays where it is.

Rows: kept are vectors of exactly `width` components, none null or not finite, and none so large once scaled that their
squared distances don't fit into 64 bits (2**26 at a width of 64). Repeated rows count as often as they occur; of equal
ids, and of null ones, which are hashed as empty text, the smaller vector starts first. With fewer vectors than k there
are as many centroids as vectors; an empty table has no result. An inertia beyond 64 bits is null. Extra columns are
left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import batch_size, written

TREE_ROWS, LEAF_ROWS = 4096, 32
FAR = np.iinfo(np.int64).max


def limit(width: int) -> int:
    """Bound of a scaled component: doubled distances to a box's middle then fit into 64 bits."""
    return math.isqrt((1 << 62) // width) // 4


def integers(df: DataFrame, width: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that are kept, v an array of integers."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < limit(width)))
    kept = df.filter((F.size(vector) == width) & sound)
    return kept.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x * scale).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k smallest hashes of their ids."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in found], np.int64)


@dataclass
class Tree:
    """Vectors in the order of the leaves, and nodes level by level: rows, first child (-1 at a leaf), box and sums."""

    vectors: np.ndarray  # rows x width, int32
    starts: np.ndarray
    ends: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray  # nodes x width, int64


_KINDS = {"vectors": np.int32, "starts": np.int32, "ends": np.int32, "child": np.int32, "low": np.int32, "high": np.int32, "sums": np.int64}
TREE_SCHEMA = "ids binary, nulls binary, " + ", ".join(f"{c} binary" for c in _KINDS)


def build(vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, Tree]:
    """The order of the rows in the tree, and the tree: nodes are halved at the median of their widest component until
    they have leaf_rows at most."""
    order = np.arange(len(vectors))
    nodes, child, low, high, sums = [(0, len(vectors))], [], [], [], []
    for a, b in nodes:  # grows meanwhile
        own = vectors[order[a:b]]
        low.append(own.min(0))
        high.append(own.max(0))
        sums.append(own.sum(0, dtype=np.int64))
        if b - a <= leaf_rows:
            child.append(-1)
            continue
        half = (b - a) // 2
        axis = int((high[-1].astype(np.int64) - low[-1]).argmax())
        order[a:b] = order[a:b][np.argpartition(own[:, axis], half)]
        child.append(len(nodes))
        nodes += [(a, a + half), (a + half, b)]
    starts, ends = np.array(nodes, np.int32).T
    return order, Tree(vectors[order], starts, ends, np.array(child, np.int32), np.array(low), np.array(high), np.array(sums))


def nearest(vectors: np.ndarray, centroids: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest allowed centroid of each vector, the smaller number on ties."""
    best, near = np.full(len(vectors), -1), np.full(len(vectors), FAR)
    for j in np.flatnonzero(allowed):
        far = ((vectors - centroids[j]) ** 2).sum(1)
        better = far < near
        best[better], near[better] = j, far[better]
    return best, near


def assign(tree: Tree, centroids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | None]]:
    """(node, centroid, None) of a node that is assigned whole; (leaf, -1, centroid of each row) of one that isn't."""
    nodes, alive = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    while len(nodes):
        low, high = tree.low[nodes].astype(np.int64), tree.high[nodes].astype(np.int64)
        to_middle = np.stack([((2 * c - low - high) ** 2).sum(1) for c in centroids], 1)
        star = centroids[np.where(alive, to_middle, FAR).argmin(1)]
        for j, c in enumerate(centroids):
            corner = np.where(c > star, high, low)  # of all points of the box, it favours c most
            alive[:, j] &= ((c - corner) ** 2).sum(1) <= ((star - corner) ** 2).sum(1)
        one = alive.sum(1) == 1
        for i in np.flatnonzero(one):
            yield int(nodes[i]), int(alive[i].argmax()), None
        leaf = ~one & (tree.child[nodes] < 0)
        for i in np.flatnonzero(leaf):
            own = tree.vectors[tree.starts[nodes[i]] : tree.ends[nodes[i]]].astype(np.int64)
            yield int(nodes[i]), -1, nearest(own, centroids, alive[i])[0]
        below = ~one & ~leaf
        first = tree.child[nodes[below]].astype(np.int64)
        nodes, alive = np.stack([first, first + 1], 1).ravel(), np.repeat(alive[below], 2, axis=0)


def plant(vectors: DataFrame, width: int, tree_rows: int = TREE_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row per kd-tree over at most tree_rows vectors of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def tree_of(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            ids = rows["vec_id"]
            flat = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            order, tree = build(flat.astype(np.int32).reshape(-1, width), leaf_rows)
            columns = [ids.fill_null(0).to_numpy()[order].astype(np.int64), ids.is_null().to_numpy()[order].astype(np.uint8)]
            columns += [getattr(tree, c).astype(kind) for c, kind in _KINDS.items()]
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["ids", "nulls", *_KINDS])

        for batch in batches:
            waiting.append(batch)
            while sum(b.num_rows for b in waiting) >= tree_rows:
                held = pa.Table.from_batches(waiting)
                yield tree_of(held.slice(0, tree_rows))
                waiting = held.slice(tree_rows).to_batches()
        if sum(b.num_rows for b in waiting):
            yield tree_of(pa.Table.from_batches(waiting))

    return vectors.mapInArrow(run, TREE_SCHEMA)


def _trees(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[Tree, np.ndarray, np.ndarray]]:
    for batch in batches:
        for r in batch.to_pylist():
            arrays = {c: np.frombuffer(r[c], kind) for c, kind in _KINDS.items()}
            wide = {c: a.reshape(-1, width) if c in ("vectors", "low", "high", "sums") else a for c, a in arrays.items()}
            yield Tree(**wide), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["nulls"], np.uint8).astype(bool)


def totals(trees: DataFrame, centroids: np.ndarray) -> list:
    """Count and sums of every cluster that has vectors: k rows at most."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for tree, _, _ in _trees(batches, width):
            for node, whole, each in assign(tree, centroids):
                if each is None:
                    n[whole] += tree.ends[node] - tree.starts[node]
                    sums[whole] += tree.sums[node]
                else:
                    np.add.at(n, each, 1)
                    np.add.at(sums, each, tree.vectors[tree.starts[node] : tree.ends[node]])
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held]), pa.array(sums[held].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    added = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    return trees.mapInArrow(run, "cluster int, n long, sums array<long>").groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect()


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round."""
    out = centroids.copy()
    for r in totals(trees, centroids):
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return out


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, ids, nulls in _trees(batches, width):
            cluster = np.empty(len(ids), np.int32)
            for node, whole, each in assign(tree, centroids):
                cluster[tree.starts[node] : tree.ends[node]] = whole if each is None else each
            distance = ((tree.vectors - centroids[cluster]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(
    df: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of every vector that is kept; centroid is an array."""
    batch_size(df.sparkSession)
    vectors = integers(df, width, scale, id_col, vector_col)
    trees = written(plant(vectors, width), "kd-trees")
    centroids = first_centroids(vectors, k, seed)
    columns = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not len(centroids):
        return df.sparkSession.createDataFrame([], columns)
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    found = written(assigned(trees, centroids), "clusters")
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}

    def by_cluster(values: dict, kind: str) -> Column:
        pairs = [F.lit(x) for c, v in sorted(values.items()) for x in (c, v)]
        return F.try_element_at(F.create_map(*pairs), F.col("cluster")).try_cast(kind)

    centroid = F.array(*(F.array(*map(F.lit, c.tolist())) for c in centroids)).cast("array<array<long>>")
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        by_cluster({c: F.lit(str(d)) for c, d in inertia.items()}, "long").alias("cluster_inertia"),
        F.lit(str(sum(inertia.values()))).try_cast("long").alias("inertia"),
        centroid[F.col("cluster")].alias("centroid"),
    )
