"""Linear radial bases over any number of stations: weights w with sum_j w_j |p_i - p_j| = value_i at every station.

The matrix of distances is never held. The equations are solved by minimal residuals over the space of the products so
far. Stations are held by regions, neighbouring domains of them, in one row a region whose columns are arrays: a round
exchanges few rows. In a product a region meets the places of regions nearby, by cells; all others act through few nodes of
the boxes that they lie in, ever larger ones with the distance, so that work grows with the stations and not with their
pairs. The driver sees scalars, the boxes and nodes of regions, and what belongs to a bounded number of coarse stations.

Products are few because each vector is first solved for nearby: a domain of neighbouring stations, with as many around
it, is solved by itself and keeps what its own stations get; what is left is then solved for at the coarse stations, which
are spread evenly.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.operators import lineage

DOMAIN, AROUND = 256, 256  # stations of a domain, and around it at most
COARSE, SHARE = 4096, 32  # stations that are solved for together in every step, whatever the number of stations; one of so many
GROUP = 8192  # stations of a block in products, on average
ORDER = 16  # nodes along a side of a box; errors of what is far are some 1e-12 of it
LEAF, DIRECT = 64, 1 << 20  # targets of a cell, on average, and pairs that are summed one by one
LEAST_SIDE = 2.0**-24  # half of one, for boxes of a single place
TOLERANCE = 1e-10  # of the residual, against the values
STEPS, RESTARTS = 40, 8
_ANGLES = (2 * np.arange(ORDER) + 1) * np.pi / (2 * ORDER)
NODES, BARYCENTRIC = np.cos(_ANGLES), np.where(np.arange(ORDER) % 2, -1, 1) * np.sin(_ANGLES)


def places(stations: DataFrame) -> DataFrame:
    """(lon, lat, value) with one row a place: stations at one place have their mean, as by least squares."""
    known = stations.filter("value is not null and not isnan(value)")
    return known.groupBy(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).agg(F.avg("value").alias("value"))


def _distances(ax, ay, bx, by) -> np.ndarray:
    d, e = ax[:, None] - bx, ay[:, None] - by
    d *= d
    e *= e
    d += e
    return np.sqrt(d, out=d)


def _numbered(points: DataFrame, count: int, size: int) -> DataFrame:
    """Points with `id` and `dom`: strips of longitude, cut by latitude into domains of `size` at most, whose boxes don't
    overlap. A strip is a partition; as many strips as domains in one make the boxes of evenly spread points square."""
    strips = max(1, math.ceil(math.sqrt(count / size)))
    ranged = points.repartitionByRange(strips, "lon", "lat").sortWithinPartitions("lat", "lon")
    # The number of a row is its partition and its place there.
    held = ranged.withColumn("id", F.monotonically_increasing_id())
    place = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    dom = F.shiftleft(F.shiftright("id", 33), 32) + F.floor(place / size)
    return lineage.cut(held.select("id", dom.alias("dom"), "lon", "lat", "value"))


def _members(points: DataFrame, around: int) -> DataFrame:
    """(dom, own, id, lon, lat): each domain's stations, and up to `around` of others that lie nearest to its box."""
    box = points.groupBy("dom").agg(F.min("lon").alias("_w"), F.max("lon").alias("_e"), F.min("lat").alias("_s"), F.max("lat").alias("_n"))
    size = F.greatest(F.col("_e") - F.col("_w"), F.col("_n") - F.col("_s"), F.lit(2.0**-24))
    # Tiles as wide as the box at least, in powers of two: with its margin a box meets nine of them at most.
    box = box.withColumn("_m", size / 2).withColumn("_level", F.ceil(F.log2(size)).cast("int"))
    tile = lambda c, level: F.floor(c / F.pow(F.lit(2.0), level))
    spread = lambda a, b: F.explode(F.sequence(tile(F.col(a) - F.col("_m"), F.col("_level")), tile(F.col(b) + F.col("_m"), F.col("_level"))))
    tiled = box.withColumn("_tx", spread("_w", "_e")).withColumn("_ty", spread("_s", "_n"))
    levels = box.agg(F.array_sort(F.collect_set("_level"))).first()[0]  # powers of two, some thirty at most
    at = points.withColumnRenamed("dom", "_of").withColumn("_level", F.explode(F.array(*map(F.lit, levels))))
    at = at.withColumn("_tx", tile(F.col("lon"), F.col("_level"))).withColumn("_ty", tile(F.col("lat"), F.col("_level")))
    gap = lambda c, a, b: F.greatest(F.col(a) - F.col(c), F.col(c) - F.col(b), F.lit(0.0))
    near = at.join(tiled, ["_level", "_tx", "_ty"]).filter("dom != _of").withColumn("_d", F.hypot(gap("lon", "_w", "_e"), gap("lat", "_s", "_n")))
    rank = F.row_number().over(Window.partitionBy("dom").orderBy("_d", "id"))
    extra = near.filter("_d <= _m").withColumn("_r", rank).filter(F.col("_r") <= around).select("dom", F.lit(False).alias("own"), "id", "lon", "lat")
    return lineage.cut(points.select("dom", F.lit(True).alias("own"), "id", "lon", "lat").unionByName(extra))


def _blocked(points: DataFrame, groups: int) -> DataFrame:
    """Points with `_b`, the number of their block: about `groups` of them, evenly filled, in strips as domains are."""
    size = max(1, -(-points.count() // groups))
    strips = max(1, math.ceil(math.sqrt(groups)))
    held = points.repartitionByRange(strips, "lon", "lat").sortWithinPartitions("lat", "lon").withColumn("_p", F.monotonically_increasing_id())
    place = F.col("_p").bitwiseAND(F.lit((1 << 33) - 1))
    return lineage.cut(held.withColumn("_b", F.shiftleft(F.shiftright("_p", 33), 32) + F.floor(place / size)).drop("_p"))


def _polynomials(at: np.ndarray) -> np.ndarray:
    """The polynomials that are 1 at one of the nodes from -1 to 1 and 0 at the others, a row for each place."""
    away = at[:, None] - NODES
    on = away == 0
    share = np.where(on.any(1, keepdims=True), on, BARYCENTRIC / np.where(on, 1, away))
    return share / share.sum(1, keepdims=True)


def _basis(at: np.ndarray, low: float, high: float) -> np.ndarray:
    """The same over the stretch from low to high."""
    return _polynomials((at - (low + high) / 2) / max((high - low) / 2, LEAST_SIDE))


def _nodes(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a box's nodes."""
    x, y = (c + np.maximum(h, LEAST_SIDE) * NODES for c, h in zip((low + high) / 2, (high - low) / 2, strict=True))
    return np.repeat(x, ORDER), np.tile(y, ORDER)


def _proxies(x: np.ndarray, y: np.ndarray, w: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Weights at a box's nodes that far away act as the weights at places within it."""
    return (_basis(x, low[0], high[0]) * w[:, None]).T @ _basis(y, low[1], high[1])


def _summed(ax, ay, bx, by, w) -> np.ndarray:
    """Sums of w times the distances, in pieces that stay in a processor's cache."""
    out, bx, by = np.zeros(len(ax)), np.ascontiguousarray(bx), np.ascontiguousarray(by)
    for j in range(0, len(bx), 2048):
        px, py, pw = bx[j : j + 2048], by[j : j + 2048], w[j : j + 2048]
        for i in range(0, len(ax), 16):
            d, e = ax[i : i + 16, None] - px, ay[i : i + 16, None] - py
            d *= d
            e *= e
            d += e
            out[i : i + 16] += np.sqrt(d, out=d) @ pw
    return out


#: From the nodes of the lower and the upper half of a stretch to its own polynomials.
HALVES = tuple(_polynomials(NODES / 2 + side) for side in (-0.5, 0.5))


@functools.cache
def _meetings(px: int, py: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Cells that act through their nodes on a cell that is the px-th, py-th of its parent's: the children of the parent
    and of its neighbours that don't touch it. Offsets, and distances of their nodes from the cell's, for cells of side 2."""
    offsets = [(dx, dy) for dx in range(-2 - px, 4 - px) for dy in range(-2 - py, 4 - py) if max(abs(dx), abs(dy)) > 1]
    x, y = np.repeat(NODES, ORDER), np.tile(NODES, ORDER)
    return offsets, np.concatenate([np.hypot((x + 2 * dx)[:, None] - x, (y + 2 * dy)[:, None] - y) for dx, dy in offsets])


def _fast_sums(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sums of `_summed`, in a time that grows with the places and not with their pairs.

    The square around the targets is cut into cells by fours. Sources within a side of it lie in such cells too, and act on
    cells that don't touch theirs through nodes; sources farther away act on the nodes of the square. What is left is
    summed one by one, or in the same way where many places lie in one cell."""
    side = max(np.ptp(ax), np.ptp(ay)) if len(ax) else 0.0
    if len(ax) <= ORDER * ORDER or len(ax) * len(bx) <= DIRECT or side <= 2 * LEAST_SIDE:
        return _summed(ax, ay, bx, by, w)
    x0, y0 = (ax.min() + ax.max() - side) / 2, (ay.min() + ay.max() - side) / 2
    levels = max(1, min(6, round(math.log(len(ax) / LEAF, 4))))
    n = 2**levels
    # In sides of the square, with the square from 1 to 2.
    ux, uy, vx, vy = (ax - x0) / side + 1, (ay - y0) / side + 1, (bx - x0) / side + 1, (by - y0) / side + 1
    inside = (vx >= 0) & (vx < 3) & (vy >= 0) & (vy < 3)
    root = x0 + side * (NODES + 1) / 2, y0 + side * (NODES + 1) / 2
    local = _summed(np.repeat(root[0], ORDER), np.tile(root[1], ORDER), bx[~inside], by[~inside], w[~inside]).reshape(1, 1, ORDER, ORDER)

    def dealt(u, v, cells):
        """Order by cells, where each cell begins, and polynomials at the places in their cells."""
        i, j = (np.clip((c * n).astype(int), 0, 3 * n - 1) for c in (u, v))
        if cells < 3 * n:  # targets lie in the middle third, its end included
            i, j = np.clip(i - n, 0, n - 1), np.clip(j - n, 0, n - 1)
        at = i * cells + j
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(cells * cells + 1))
        shift = 0 if cells == 3 * n else n
        px, py = (_polynomials(2 * (c[order] * n - k[order] - shift) - 1) for c, k in ((u, i), (v, j)))
        return order, first, px, py

    near = np.flatnonzero(inside)
    order, first, px, py = dealt(vx[near], vy[near], 3 * n)
    sx, sy, sw = bx[near][order], by[near][order], w[near][order]
    held = np.zeros((9 * n * n, ORDER, ORDER))
    weighted = px * sw[:, None]
    for c in np.flatnonzero(np.diff(first)):
        held[c] = weighted[first[c] : first[c + 1]].T @ py[first[c] : first[c + 1]]
    proxies = [held.reshape(3 * n, 3 * n, ORDER, ORDER)]
    for _ in range(levels - 1):
        proxies.append(sum(HALVES[i].T @ proxies[-1][i::2, j::2] @ HALVES[j] for i in (0, 1) for j in (0, 1)))
    for level in range(1, levels + 1):
        m, held = 2**level, proxies[levels - level].reshape(3 * 2**level, 3 * 2**level, ORDER * ORDER)
        down = np.empty((m, m, ORDER, ORDER))
        for i in (0, 1):
            for j in (0, 1):
                offsets, distances = _meetings(i, j)
                met = np.concatenate([held[m + i + dx : 2 * m + dx + i : 2, m + j + dy : 2 * m + dy + j : 2] for dx, dy in offsets], axis=2)
                through = met.reshape(m * m // 4, -1) @ distances * (side / m / 2)
                down[i::2, j::2] = HALVES[i] @ local @ HALVES[j].T + through.reshape(m // 2, m // 2, ORDER, ORDER)
        local = down

    aims, begin, px, py = dealt(ux, uy, n)
    out = np.empty(len(ax))
    for c in np.flatnonzero(np.diff(begin)):
        i, j = divmod(int(c), n)
        mine = slice(begin[c], begin[c + 1])
        rows = [slice(first[k * 3 * n + j + n - 1], first[k * 3 * n + j + n + 2]) for k in range(i + n - 1, i + n + 2)]
        around = (np.concatenate([s[r] for r in rows]) for s in (sx, sy, sw))
        out[aims[mine]] = ((px[mine] @ local[i, j]) * py[mine]).sum(1) + _fast_sums(ax[aims[mine]], ay[aims[mine]], *around)
    return out


class _Tree:
    """Boxes of blocks, halved by their middles up to one box of all. Nodes are numbered blocks first, halves before what
    they make up."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.leaves, self.low, self.high = len(low), list(low), list(high)
        self.halves: list[tuple[int, int]] = [(-1, -1)] * len(low)
        middle = (low + high) / 2

        def build(held: np.ndarray) -> int:
            if len(held) == 1:
                return int(held[0])
            spread = np.ptp(middle[held], axis=0)
            held = held[np.argsort(middle[held, int(spread[1] > spread[0])], kind="stable")]
            a, b = build(held[: len(held) // 2]), build(held[len(held) // 2 :])
            self.low.append(np.minimum(self.low[a], self.low[b]))
            self.high.append(np.maximum(self.high[a], self.high[b]))
            self.halves.append((a, b))
            return len(self.low) - 1

        self.root = build(np.arange(len(low)))
        self.low, self.high, self.halves = np.array(self.low), np.array(self.high), np.array(self.halves)
        self.side = (self.high - self.low).max(1)

    def parted(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of given boxes and nodes, which together hold each block once for each box: boxes, nodes and gaps of those
        that lie apart by a node's side at least, and boxes and blocks of those that don't."""
        box, node = np.arange(len(low)), np.full(len(low), self.root)
        far, close = [], []
        while len(box):
            gap = np.hypot(*np.maximum(np.maximum(self.low[node] - high[box], low[box] - self.high[node]), 0).T)
            apart = (gap >= self.side[node]) & (gap > 0)
            far.append((box[apart], node[apart], gap[apart]))
            box, node = box[~apart], node[~apart]
            leaf = node < self.leaves
            close.append((box[leaf], node[leaf]))
            box, node = np.repeat(box[~leaf], 2), self.halves[node[~leaf]].ravel()
        return *(np.concatenate(c) for c in zip(*far, strict=True)), *(np.concatenate(c) for c in zip(*close, strict=True))

    def raised(self, proxies: np.ndarray) -> np.ndarray:
        """Proxies of all nodes from those of the blocks."""
        out = np.zeros((len(self.low), ORDER, ORDER))
        out[: self.leaves] = proxies
        for i in range(self.leaves, len(out)):
            for half in self.halves[i]:
                x, y = (_basis((self.low[half, c] + self.high[half, c]) / 2 + max((self.high[half, c] - self.low[half, c]) / 2, LEAST_SIDE) * NODES, self.low[i, c], self.high[i, c]) for c in (0, 1))
                out[i] += x.T @ out[half] @ y
        return out

    def far_nodes(self, low: np.ndarray, high: np.ndarray, proxies: np.ndarray) -> list[np.ndarray]:
        """Places and weights of the nodes of all boxes that lie apart from the given one."""
        node = self.parted(low[None], high[None])[1]
        if not len(node):
            return [np.zeros(0)] * 3
        x, y = (np.concatenate(c) for c in zip(*(_nodes(self.low[i], self.high[i]) for i in node), strict=True))
        return [x, y, proxies[node].ravel()]


def _bytes(*arrays) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


class Sums:
    """Sums of distances from targets to weighted sources, both with their places and `_b`, for any number of weights.

    A block of targets meets the sources of blocks nearby, by cells; all others through the nodes of the tree's boxes,
    polynomials of the order ORDER. The driver has boxes and nodes of the blocks only. A block's sources are one row, as
    arrays, so that few rows are exchanged."""

    def __init__(self, targets: DataFrame, sources: DataFrame):
        self.targets, self.spark = targets, targets.sparkSession
        self.blocks, low, high = self._boxes(sources)
        self.aims, self.low, self.high = (self.blocks, low, high) if targets is sources else self._boxes(targets)
        self.tree = _Tree(low, high) if len(low) else None
        self.tasks = max(1, min(2 * len(self.aims), 16 * self.spark.sparkContext.defaultParallelism))
        at, block = self.tree.parted(self.low, self.high)[3:] if len(self.aims) and len(low) else ([], [])
        self.close = self.spark.createDataFrame([(self.aims[t], self.blocks[b]) for t, b in zip(at, block, strict=True)], "_t long, _b long")
        if len(low):
            self.boxes = self.spark.sparkContext.broadcast({b: (i, low[i], high[i]) for i, b in enumerate(self.blocks)})

    @staticmethod
    def _boxes(df: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray]:
        rows = df.groupBy("_b").agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).orderBy("_b").collect()
        box = np.array([r[1:] for r in rows], float).reshape(-1, 4)
        return [r[0] for r in rows], box[:, :2], box[:, 2:]

    def meeting(self, proxies: dict[int, np.ndarray]):
        """A function of places of targets, their block and the rows of the sources nearby, for the tasks; proxies by block."""
        tree = self.tree
        held = np.zeros((tree.leaves, ORDER, ORDER))
        for i, b in enumerate(self.blocks):
            held[i] = proxies[b]
        aim = {t: i for i, t in enumerate(self.aims)}
        all_of = self.spark.sparkContext.broadcast((tree, tree.raised(held), aim, self.low, self.high))

        def met(x: np.ndarray, y: np.ndarray, block: int, near: pd.DataFrame) -> np.ndarray:
            tree, proxies, aim, low, high = all_of.value
            far = tree.far_nodes(low[aim[block]], high[aim[block]], proxies)
            return _fast_sums(x, y, *(np.concatenate([f, *map(np.frombuffer, near[c])]) for f, c in zip(far, ("lon", "lat", "w"), strict=True)))

        return met

    def nearby(self, packed: DataFrame):
        """The rows (_b, lon, lat, w) of blocks of sources, once for each block of targets nearby, grouped by it."""
        return packed.join(F.broadcast(self.close), "_b").select("_t", "_b", "lon", "lat", "w").repartition(self.tasks, "_t").groupBy("_t")

    def of(self, sources: DataFrame, names: list[str]) -> DataFrame:
        """(names, value) of the targets; sources are (_b, lon, lat, w)."""
        schema = ", ".join(f"`{n}` {dict(self.targets.dtypes)[n]}" for n in names) + ", value double"
        if self.tree is None:
            return self.targets.select(*names, F.lit(0.0).alias("value"))
        boxes = self.boxes

        def packed(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
            x, y, w = (f[c].to_numpy(float) for c in ("lon", "lat", "w"))
            return pd.DataFrame([[key[0], *_bytes(x, y, w, _proxies(x, y, w, *boxes.value[key[0]][1:]))]], columns=["_b", "lon", "lat", "w", "p"])

        rows = lineage.cut(sources.select("_b", "lon", "lat", "w").repartition(self.tasks, "_b").groupBy("_b").applyInPandas(packed, "_b long, lon binary, lat binary, w binary, p binary"))
        met = self.meeting({r["_b"]: np.frombuffer(r["p"]).reshape(ORDER, ORDER) for r in rows.select("_b", "p").collect()})  # a block's nodes, not its places

        def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return a[names].assign(value=met(a["_x"].to_numpy(float), a["_y"].to_numpy(float), key[0], b) if len(a) else 0.0)

        aims = self.targets.select(F.col("_b").alias("_t"), F.col("lon").alias("_x"), F.col("lat").alias("_y"), *names).repartition(self.tasks, "_t")
        return aims.groupBy("_t").cogroup(self.nearby(rows)).applyInPandas(meet, schema)


def distance_sums(targets: DataFrame, sources: DataFrame, keys: list[str], target_groups: int, source_groups: int) -> DataFrame:
    """(keys, value): for each target, the sum over all sources (lon, lat, w) of w times its distance, by so many blocks."""
    names = [f"_k{i}" for i in range(len(keys))]
    t = targets.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    s = _blocked(sources.select("lon", "lat", "w"), source_groups)
    return Sums(_blocked(t, target_groups), s).of(s, names).select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), "value")


def _regions(low: np.ndarray, high: np.ndarray, most: int) -> np.ndarray:
    """Numbers of regions of `most` boxes at most, halved by their middles."""
    out, middle, todo, made = np.zeros(len(low), int), (low + high) / 2, [np.arange(len(low))], 0
    while todo:
        held = todo.pop()
        if len(held) <= most:
            out[held], made = made, made + 1
            continue
        spread = np.ptp(middle[held], axis=0)
        held = held[np.argsort(middle[held, int(spread[1] > spread[0])], kind="stable")]
        todo += [held[len(held) // 2 :], held[: len(held) // 2]]
    return out


def _spread(x: np.ndarray, y: np.ndarray, count: int) -> np.ndarray:
    """The numbers of so many places, evenly spread: of as many boxes, the one next to the middle of each."""
    out, todo = [], [(np.arange(len(x)), min(count, len(x)))]
    while todo:
        held, k = todo.pop()
        px, py = x[held], y[held]
        if k == 1:
            out.append(int(held[np.argmin((px - px.mean()) ** 2 + (py - py.mean()) ** 2)]))
        elif k > 1:
            held = held[np.argsort(py if np.ptp(py) > np.ptp(px) else px, kind="stable")]
            cut = len(held) * (k // 2) // k
            todo += [(held[:cut], k // 2), (held[cut:], k - k // 2)]
    return np.array(sorted(out), int)


def _solve_domain(x: np.ndarray, y: np.ndarray, r: np.ndarray) -> np.ndarray:
    n = len(x)
    k = np.ones((n + 1, n + 1))  # the domain's weights add up to 0, a constant takes the rest
    k[n, n], d, e = 0, k[:n, :n], y[:, None] - y
    np.subtract(x[:, None], x, out=d)
    d *= d
    e *= e
    d += e
    np.sqrt(d, out=d)
    return np.linalg.solve(k, np.append(r, 0.0))[:n]


class _Stations:
    """The stations by regions of neighbouring domains. `state` has a row a region, whose columns are arrays over its
    stations: id, lon, lat, value, weights w, what is left r, the newest vector u, all vectors v of the basis of the
    products and what was multiplied z. The driver sees boxes and nodes of regions, and the coarse stations."""

    LOCAL = "_b long, lon binary, lat binary, w binary, p binary, c binary, s binary"
    STATE = "_b long, id binary, lon binary, lat binary, value binary, w binary, r binary, u binary, v binary, z binary, g binary"

    def __init__(self, known: DataFrame, count: int, domain: int, around: int, coarse: int, group: int):
        self.domain, spark = domain, known.sparkSession
        points = _numbered(known, count, domain)
        doms, low, high = Sums._boxes(points.withColumnRenamed("dom", "_b"))
        region = _regions(low, high, max(1, group // domain))
        of = spark.createDataFrame([(d, int(b)) for d, b in zip(doms, region, strict=True)], "dom long, _b long")
        points = points.join(F.broadcast(of), "dom")
        extra = _members(points.drop("_b", "value"), around).filter("not own").join(F.broadcast(of), "dom")
        # The place of a station's domain is in its number.
        home = F.shiftleft(F.shiftright("id", 33), 32) + F.floor(F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) / domain)
        extra = lineage.cut(extra.withColumn("_dom", home).join(F.broadcast(of.toDF("_dom", "_s")), "_dom").select("_b", "_s", "dom", "id", "lon", "lat"))
        own = [(int(b), int(b)) for b in set(region)]
        self.lent = lineage.cut(extra.select(F.col("_b").alias("_t"), F.col("_s").alias("_b")).union(spark.createDataFrame(own, "_t long, _b long")).distinct())
        self.sums = Sums(points, points)
        self.tasks = self.sums.tasks

        def packed(key: tuple, f: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
            f, e = f.sort_values("id"), e.sort_values(["dom", "id"])
            columns = [f["id"], f["lon"], f["lat"], f["value"], e["dom"], e["id"], e["lon"], e["lat"]]
            return pd.DataFrame([[key[0], len(f), *_bytes(*(c.to_numpy() for c in columns))]])

        kinds = "_b long, n long, id binary, lon binary, lat binary, value binary, e_dom binary, e_id binary, e_lon binary, e_lat binary"
        by = lambda df: df.repartition(self.tasks, "_b").groupBy("_b")
        self.fixed = lineage.cut(by(points.drop("dom")).cogroup(by(extra.drop("_s"))).applyInPandas(packed, kinds))
        self._choose(min(coarse, count))

    def _choose(self, coarse: int) -> None:
        """Coarse stations, evenly spread over each region: their matrix fits into a task, whatever the number of stations."""
        sizes = sorted(tuple(r) for r in self.fixed.select("_b", "n").collect())
        ends = np.cumsum([0] + [n for _, n in sizes]) * coarse // sum(n for _, n in sizes)
        share = dict(zip((b for b, _ in sizes), np.diff(ends).tolist(), strict=True))

        def chosen(frames):
            for f in frames:
                for b, x, y in zip(f["_b"], map(np.frombuffer, f["lon"]), map(np.frombuffer, f["lat"]), strict=True):
                    at = _spread(x, y, share[b])
                    yield pd.DataFrame({"_b": b, "at": at, "lon": x[at], "lat": y[at]})

        rows = self.fixed.select("_b", "lon", "lat").mapInPandas(chosen, "_b long, at int, lon double, lat double").collect()
        x, y = (np.array([r[c] for r in rows]) for c in ("lon", "lat"))
        self.places = {b: [] for b, _ in sizes}  # of coarse stations, by region: in its arrays, and among them all
        for i, r in enumerate(rows):
            self.places[r["_b"]].append((r["at"], i))
        self.places = {b: np.array(p, int).reshape(-1, 2) for b, p in self.places.items()}
        spark = self.fixed.sparkSession
        self.coarse, self.x, self.y = spark.sparkContext.broadcast((x, y, self.places)), x, y
        places = self.coarse

        def inverted(frames):
            for _ in frames:
                x, y, _ = places.value
                rows = np.linalg.inv(_distances(x, y, x, y))
                for i in range(0, len(rows), 256):
                    yield pd.DataFrame({"i": np.arange(i, min(i + 256, len(rows))), "a": _bytes(*rows[i : i + 256])})

        one = spark.range(1, numPartitions=1).mapInPandas(inverted, "i int, a binary")
        self.inverse = lineage.cut(one.repartition(spark.sparkContext.defaultParallelism, "i"))

    def _lacking(self, lack: np.ndarray) -> np.ndarray:
        """Weights of the coarse stations for what is lacking there."""
        given = self.fixed.sparkSession.sparkContext.broadcast(lack)

        def times(frames):
            for f in frames:
                yield pd.DataFrame({"i": f["i"], "s": [np.frombuffer(a) @ given.value for a in f["a"]]})

        out = np.zeros(len(lack))
        for r in self.inverse.mapInPandas(times, "i int, s double").collect():
            out[r["i"]] = r["s"]
        return out

    def solved(self, state: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray], np.ndarray]:
        """What the newest vector needs of weights: by domains, in rows LOCAL; then what the coarse stations lack of it.
        With these, nodes of the regions."""
        coarse, boxes, size = self.coarse, self.sums.boxes, self.domain

        def solve(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            (cx, cy, places), (_, low, high), own = coarse.value, boxes.value[key[0]], a.iloc[0]
            ids, x, y, dom, e_id, ex, ey = (np.frombuffer(own[c], t) for c, t in (("id", "i8"), ("lon", "f8"), ("lat", "f8"), ("e_dom", "i8"), ("e_id", "i8"), ("e_lon", "f8"), ("e_lat", "f8")))
            given_id, given = np.concatenate([np.frombuffer(i, "i8") for i in b["id"]]), np.concatenate([np.frombuffer(i) for i in b["u"]])
            order = np.argsort(given_id)
            find = lambda i: given[order[np.searchsorted(given_id, i, sorter=order)]]
            r, er = find(ids), find(e_id)
            home = (ids >> 33 << 32) + (ids & (1 << 33) - 1) // size
            first = np.flatnonzero(np.diff(home, prepend=-1))
            out = np.empty(len(ids))
            for i, j in zip(first, [*first[1:], len(ids)], strict=True):
                e = slice(*np.searchsorted(dom, [home[i], home[i] + 1]))
                out[i:j] = _solve_domain(*(np.append(c[i:j], d[e]) for c, d in ((x, ex), (y, ey), (r, er))))[: j - i]
            proxies, s = _proxies(x, y, out, low, high), np.empty(len(cx))
            gap = np.hypot(*(np.maximum(np.maximum(a - c, c - b), 0) for a, b, c in zip(low, high, (cx, cy), strict=True)))
            far = gap >= max(*(high - low), LEAST_SIDE)
            s[far] = _summed(cx[far], cy[far], *_nodes(low, high), proxies.ravel())
            s[~far] = _fast_sums(cx[~far], cy[~far], x, y, out)
            columns = x, y, out, proxies, r[places[key[0]][:, 0]], s
            return pd.DataFrame([[key[0], *_bytes(*columns)]])

        def summed(frames):
            total = None
            for f in frames:
                for s in f["s"]:
                    total = np.frombuffer(s) + (0.0 if total is None else total)
                yield f[["_b", "p", "c"]].assign(s=None)
            if total is not None:
                yield pd.DataFrame({"_b": [-1], "p": [b""], "c": [b""], "s": _bytes(total)})

        lent = state.select("_b", "id", "u").join(F.broadcast(self.lent), "_b").select("_t", "id", "u").repartition(self.tasks, "_t").groupBy("_t")
        fixed = self.fixed.withColumnRenamed("_b", "_t").drop("value", "n").repartition(self.tasks, "_t").groupBy("_t")
        local = lineage.cut(fixed.cogroup(lent).applyInPandas(solve, self.LOCAL))
        lack, proxies = np.zeros(len(self.x)), {}
        for row in local.select("_b", "p", "c", "s").mapInPandas(summed, "_b long, p binary, c binary, s binary").collect():
            if row["s"] is not None:
                lack -= np.frombuffer(row["s"])
            else:
                proxies[row["_b"]] = np.frombuffer(row["p"]).reshape(ORDER, ORDER)
                lack[self.places[row["_b"]][:, 1]] += np.frombuffer(row["c"])
        more, places = self._lacking(lack), self.places
        for b, (_, low, high) in boxes.value.items():
            at = places[b][:, 1]
            proxies[b] = proxies[b] + _proxies(self.x[at], self.y[at], more[at], low, high)
        more = self.fixed.sparkSession.sparkContext.broadcast(more)

        def corrected(frames):
            for f in frames:
                w = [np.frombuffer(w).copy() for w in f["w"]]
                for b, v in zip(f["_b"], w, strict=True):
                    at, i = coarse.value[2][b].T
                    v[at] += more.value[i]
                yield f.assign(w=_bytes(*w))

        return local.select("_b", "lon", "lat", "w").mapInPandas(corrected, "_b long, lon binary, lat binary, w binary"), proxies

    def multiplied(self, weighted: DataFrame, proxies: dict[int, np.ndarray], state: DataFrame) -> DataFrame:
        """(_b, x, q, d): given weights, their products with the distances, and these's products with the basis and themselves."""
        met = self.sums.meeting(proxies)

        def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            own = a.iloc[0]
            q = met(np.frombuffer(own["_x"]), np.frombuffer(own["_y"]), key[0], b)
            v = np.frombuffer(own["v"]).reshape(-1, len(q))
            return pd.DataFrame([[key[0], b["w"][b["_b"] == key[0]].iloc[0], *_bytes(q, np.append(v @ q, q @ q))]])

        aims = state.select(F.col("_b").alias("_t"), F.col("lon").alias("_x"), F.col("lat").alias("_y"), "v").repartition(self.tasks, "_t").groupBy("_t")
        return lineage.cut(aims.cogroup(self.sums.nearby(weighted)).applyInPandas(meet, "_b long, x binary, q binary, d binary"))

    def changed(self, state: DataFrame, change, moved: DataFrame | None = None) -> tuple[DataFrame, np.ndarray]:
        """The state after `change` of each row, a dict of arrays, and the sum of g."""
        kinds = {c: "i8" if c == "id" else "f8" for c, t in (state if moved is None else state.join(moved, "_b")).dtypes if t == "binary"}
        columns = [c.split()[0] for c in self.STATE.split(", ")[1:]]

        def run(frames):
            for f in frames:
                for row in f.to_dict("records"):
                    arrays = change({c: np.frombuffer(row[c], t) for c, t in kinds.items()})
                    yield pd.DataFrame([[row["_b"], *_bytes(*(arrays[c] for c in columns))]], columns=["_b", *columns])

        out = lineage.cut((state if moved is None else state.join(moved, "_b")).mapInPandas(run, self.STATE))
        return out, sum(np.frombuffer(r["g"]) for r in out.select("g").collect())


def weights(known: DataFrame, count: int, domain: int = DOMAIN, around: int = AROUND, coarse: int | None = None, group: int = GROUP, tolerance: float = TOLERANCE, steps: int = STEPS) -> DataFrame:
    """(lon, lat, w) of places (lon, lat, value), no two at one place."""
    norm = float(np.sqrt(known.agg(F.sum(F.col("value") ** 2)).first()[0]))
    if norm == 0:
        return known.select("lon", "lat", F.lit(0.0).alias("w"))
    stations = _Stations(known, count, domain, around, min(COARSE, -(-count // SHARE)) if coarse is None else coarse, group)

    def begun(a: dict) -> dict:
        none = np.zeros(0)
        return a | {"w": np.zeros(len(a["value"])), "r": a["value"], "u": a["value"] / norm, "v": a["value"] / norm, "z": none, "g": np.array([a["value"] @ a["value"]]) / norm**2}

    state, gram = stations.changed(stations.fixed.select("_b", "id", "lon", "lat", "value"), begun)
    left = norm
    for _ in range(RESTARTS):
        state, left = _cycle(stations, state, gram.reshape(1, 1), left, norm * tolerance, steps)
        if left <= norm * tolerance * 100:

            def rows(frames):
                for f in frames:
                    for row in f.to_dict("records"):
                        yield pd.DataFrame({c: np.frombuffer(row[c]) for c in ("lon", "lat", "w")})

            return state.select("lon", "lat", "w").mapInPandas(rows, "lon double, lat double, w double")
        state, gram = stations.changed(state, lambda a, left=left: a | {"u": a["r"] / left, "v": a["r"] / left, "g": np.array([a["r"] @ a["r"]]) / left**2})
    raise ValueError(f"radial bases of {count} stations: a residual of {left / norm:.1e} is left; some places may be too close to tell apart")


def _cycle(stations: _Stations, state: DataFrame, gram: np.ndarray, left: float, enough: float, steps: int) -> tuple[DataFrame, float]:
    """The state after minimal residuals over up to `steps` products, and the size of what is left then. The new vector is
    set square to the basis once; what rounding leaves is in the products of the basis with itself, which all is solved by."""
    h = np.zeros((steps + 1, steps))
    for k in range(steps):
        weighted, proxies = stations.solved(state)
        moved = stations.multiplied(weighted, proxies, state)
        row = sum(np.frombuffer(r["d"]) for r in moved.select("d").collect())
        h[: k + 1, k] = part = np.linalg.solve(gram, row[:-1])
        h[k + 1, k] = rest = float(np.sqrt(max(row[-1] - part @ row[:-1], row[-1] * 1e-30)))

        def grown(a: dict, part=part, rest=rest) -> dict:
            v = a["v"].reshape(len(part), -1)
            u = (a["q"] - part @ v) / rest
            v = np.vstack([v, u])
            return a | {"u": u, "v": v, "z": np.append(a["z"], a["x"]), "g": v @ u}

        state, new = stations.changed(state, grown, moved)
        gram = np.block([[gram, new[:-1, None]], [new[None, :-1], new[None, -1:]]])
        root = np.linalg.cholesky(gram).T  # of a combination's size
        y = np.linalg.lstsq(root @ h[: k + 2, : k + 1], left * root[:, 0], rcond=None)[0]
        over = float(np.linalg.norm(root @ (h[: k + 2, : k + 1] @ y) - left * root[:, 0]))
        if over <= enough or rest <= 1e-14 * np.abs(part).max():
            break

    def taken(a: dict) -> dict:
        w = a["w"] + y @ a["z"].reshape(len(y), -1)
        return a | {"w": w, "v": a["v"][:0], "z": a["z"][:0], "g": np.zeros(1)}

    state, _ = stations.changed(state, taken)
    boxes = stations.sums.boxes

    def shown(frames):
        for f in frames:
            yield f[["_b"]].assign(p=[_proxies(*(np.frombuffer(row[c]) for c in ("lon", "lat", "w")), *boxes.value[row["_b"]][1:]).tobytes() for row in f.to_dict("records")])

    weighted = state.select("_b", "lon", "lat", "w")
    proxies = {r["_b"]: np.frombuffer(r["p"]).reshape(ORDER, ORDER) for r in weighted.mapInPandas(shown, "_b long, p binary").collect()}
    moved = stations.multiplied(weighted, proxies, state)

    def missed(a: dict) -> dict:
        r = a["value"] - a["q"]
        return a | {"r": r, "g": np.array([r @ r])}

    state, over = stations.changed(state, missed, moved)
    return state, float(np.sqrt(over[0]))
