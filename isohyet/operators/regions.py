"""Zone rasters as polygons: connected regions, their rings, smoothing by distance, and zones put together.

A raster is a table (row_idx, col_idx, zone) of the cells of a regular grid. It is cut into square tiles, each of which is
worked on as an array by one task; what crosses tile borders is settled by joins on the border cells alone. A polygon is
one row with all its rings, so a region's corners meet in one task; its cells never do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.operators.lineage import cut
from isohyet.operators.spatial import edges_of_rings

TILE = 256
LINES = 10_000  # sides that are traced together, on average


def _array(f: pd.DataFrame, column: str, halo: int = 0) -> tuple[np.ndarray, np.ndarray, int, int]:
    """A tile's cells as an array with a margin of one and the halo, which cells are there, and its first row and column."""
    top, left = int(f["row_idx"].min()) - halo - 1, int(f["col_idx"].min()) - halo - 1
    shape = int(f["row_idx"].max()) - top + halo + 2, int(f["col_idx"].max()) - left + halo + 2
    values, there = np.zeros(shape, f[column].to_numpy().dtype), np.zeros(shape, bool)
    at = f["row_idx"].to_numpy() - top, f["col_idx"].to_numpy() - left
    values[at], there[at] = f[column], True
    return values, there, top, left


def label(values: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Of each cell the first place, in the order of rows, of its region of equal neighbours; -1 where no cell is."""
    place = np.arange(values.size).reshape(values.shape)
    found = np.where(there, place, -1)
    while True:
        before = found
        for turned in (False, True):
            v, t, p = (a.T if turned else a for a in (values, there, found))
            v, t, flat = v.ravel(), t.ravel(), p.ravel()
            new = np.ones(v.size, bool)  # a run of equal cells begins
            new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
            new[:: p.shape[1]] = True
            starts = np.flatnonzero(new)
            low = np.minimum.reduceat(flat, starts)
            joined = np.repeat(low, np.diff(np.append(starts, v.size))).reshape(p.shape)
            found = joined.T if turned else joined
        if (found == before).all():
            return found


def regions(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """(row_idx, col_idx, zone, region): cells with the number of their region of equal zones, joined over sides. A cell
    without a zone has no region; of repeated cells that with the smallest zone counts."""
    once = cells.filter("zone is not null").groupBy("row_idx", "col_idx").agg(F.min("zone").cast("long").alias("zone"))

    def labelled(f: pd.DataFrame) -> pd.DataFrame:
        values, there, top, left = _array(f, "zone")
        first = label(values, there)[f["row_idx"] - top, f["col_idx"] - left]
        y, x = np.divmod(first, values.shape[1])
        return pd.DataFrame({"row_idx": f["row_idx"], "col_idx": f["col_idx"], "zone": f["zone"], "part": ((y + top).astype(np.int64) << 32) + (x + left)})

    keys = [F.floor(F.col(c) / tile).alias(k) for c, k in (("row_idx", "_ty"), ("col_idx", "_tx"))]
    parts = cut(once.groupBy(*keys).applyInPandas(labelled, "row_idx long, col_idx long, zone long, part long"))
    # Neighbours over a tile's border meet on the cell behind it.
    links = None
    for c in ("row_idx", "col_idx"):
        last = parts.filter(F.pmod(c, F.lit(tile)) == tile - 1).select(F.col("zone").alias("z"), F.col("part").alias("a"), *((F.col(k) + 1 if k == c else F.col(k)).alias(k) for k in ("row_idx", "col_idx")))
        met = last.join(parts.filter(F.pmod(c, F.lit(tile)) == 0), ["row_idx", "col_idx"]).filter("z = zone").select("a", F.col("part").alias("b")).distinct()
        links = met if links is None else links.unionByName(met)
    named = smallest_reachable(links).select(F.col("node").alias("part"), "region")
    return parts.join(named, "part", "left").select("row_idx", "col_idx", "zone", F.coalesce("region", "part").alias("region"))


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, region) of every node of the links (a, b): the smallest node that it is connected with. Each round takes the
    smallest label of the neighbours, and the label of that label."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = cut(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("u").alias("v"), F.col("label").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
        jump = labels.select(F.col("u").alias("near"), F.col("label").alias("next"))
        new = cut(labels.join(near, "u").join(jump, "near", "left").select("u", F.col("label").alias("old"), F.least("label", "near", "next").alias("label")))
        if new.filter("old <> label").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("label").alias("region"))
        labels = new.select("u", "label")


#: Sides of a cell, run with the cell on the left: neighbour's offset, and the side's ends from the cell's corner (x, y).
_SIDES = [((-1, 0), (0, 0), (1, 0)), ((0, 1), (1, 0), (1, 1)), ((1, 0), (1, 1), (0, 1)), ((0, -1), (0, 1), (0, 0))]


def border_edges(found: DataFrame, tile: int = TILE) -> DataFrame:
    """(region, zone, x1, y1, x2, y2) of all sides between different regions, in cell corners, each region on the left of
    its own."""
    schema = "region long, zone long, x1 long, y1 long, x2 long, y2 long, open boolean"

    def sides(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        values, there, top, left = _array(f, "region")
        row, col = f["row_idx"].to_numpy(), f["col_idx"].to_numpy()
        out = []
        for (dy, dx), (ax, ay), (bx, by) in _SIDES:
            beyond = (np.floor_divide(row + dy, tile) != key[0]) | (np.floor_divide(col + dx, tile) != key[1])
            at = row - top + dy, col - left + dx
            kept = beyond | ~there[at] | (values[at] != f["region"].to_numpy())
            own = f[kept]
            x, y = own["col_idx"], own["row_idx"]
            out.append(pd.DataFrame({"region": own["region"], "zone": own["zone"], "x1": x + ax, "y1": y + ay, "x2": x + bx, "y2": y + by, "open": beyond[kept]}))
        return pd.concat(out)

    keys = [F.floor(F.col(c) / tile).alias(k) for c, k in (("row_idx", "_ty"), ("col_idx", "_tx"))]
    every = found.groupBy(*keys).applyInPandas(sides, schema)
    # A side on a tile's border is seen from both tiles: it stays where the regions differ, or where nothing is beyond.
    line = [F.least("x1", "x2").alias("_x"), F.least("y1", "y2").alias("_y"), (F.col("y1") == F.col("y2")).alias("_flat")]
    edge = F.struct("region", "zone", "x1", "y1", "x2", "y2")
    over = every.filter("open").groupBy(*line).agg(F.collect_list(edge).alias("_e")).filter((F.size("_e") == 1) | (F.col("_e")[0]["region"] != F.col("_e")[1]["region"])).select(F.explode("_e").alias("_e")).select("_e.*")
    return every.filter("not open").drop("open").unionByName(over)


def straight(edges: DataFrame, tile: int = TILE) -> DataFrame:
    """Edges put together along straight lines, within a tile's length: fewer rows go on to the tracing."""
    flat = F.col("y1") == F.col("y2")
    along, forward = F.when(flat, F.least("x1", "x2")).otherwise(F.least("y1", "y2")), F.when(flat, F.col("x2") > F.col("x1")).otherwise(F.col("y2") > F.col("y1"))
    marked = edges.select("region", "zone", flat.alias("_flat"), forward.alias("_up"), F.when(flat, F.col("y1")).otherwise(F.col("x1")).alias("_on"), along.alias("_at")).withColumn("_t", F.floor(F.col("_at") / tile))
    line = Window.partitionBy("region", "zone", "_flat", "_up", "_on", "_t").orderBy("_at")
    runs = marked.withColumn("_run", F.col("_at") - F.row_number().over(line)).groupBy("region", "zone", "_flat", "_up", "_on", "_t", "_run").agg(F.min("_at").alias("_a"), (F.max("_at") + 1).alias("_b"))
    first, last = F.when(F.col("_up"), F.col("_a")).otherwise(F.col("_b")), F.when(F.col("_up"), F.col("_b")).otherwise(F.col("_a"))
    end = lambda along, x: F.when(F.col("_flat"), along if x else F.col("_on")).otherwise(F.col("_on") if x else along)
    return runs.select("region", "zone", end(first, True).alias("x1"), end(first, False).alias("y1"), end(last, True).alias("x2"), end(last, False).alias("y2"))


def trace(edges: np.ndarray) -> list[np.ndarray]:
    """Closed rings of directed edges (x1, y1, x2, y2), corners only. Where two rings touch at a corner, the one that
    stays with its own cell is followed, so that rings don't cross and a region is joined by sides only."""
    leaving: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(edges[:, :2].tolist()):
        leaving.setdefault((x, y), []).append(i)
    step = np.sign(edges[:, 2:] - edges[:, :2])
    rings, used = [], np.zeros(len(edges), bool)
    for first in np.lexsort((edges[:, 0], edges[:, 1])).tolist():
        if used[first]:
            continue
        ring, at = [], first
        while not used[at]:
            used[at] = True
            ring.append(edges[at, :2])
            ways = [i for i in leaving[tuple(edges[at, 2:].tolist())] if not used[i] or i == first]
            if not ways:
                break
            # With the cell on the right-hand turn of the raster's axes (y runs down), a turn towards it stays with it.
            turn = lambda i: int(step[at, 0] * step[i, 1] - step[at, 1] * step[i, 0])  # noqa: B023, E731
            at = max(ways, key=turn)
        points = np.array(ring)
        ahead, behind = np.roll(points, -1, 0) - points, points - np.roll(points, 1, 0)
        rings.append(points[ahead[:, 0] * behind[:, 1] != ahead[:, 1] * behind[:, 0]])
    return rings


def area(ring: np.ndarray) -> float:
    """Twice the signed area."""
    x, y = ring[:, 0].astype(float), ring[:, 1].astype(float)
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())


def polygons(cells: DataFrame, tile: int = TILE, min_x: float = 0.0, min_y: float = 0.0, step: float = 1.0) -> DataFrame:
    """(region, zone, rings, cells) of each connected region of a raster: the outer ring first, then the holes, as corners
    of cells whose centres are at min_x + step * col_idx and min_y + step * row_idx."""
    found = cut(regions(cells, tile))
    sizes = found.groupBy("region").agg(F.count(F.lit(1)).alias("cells"))

    def traced(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("region")
        first = np.flatnonzero(np.append(True, np.diff(f["region"].to_numpy()) != 0))
        found = []
        for edges in np.split(f[["x1", "y1", "x2", "y2"]].to_numpy(), first[1:]):
            rings = sorted(trace(edges), key=area, reverse=True)
            found.append([[{"x": min_x + step * (x - 0.5), "y": min_y + step * (y - 0.5)} for x, y in r.tolist()] for r in rings])
        return pd.DataFrame({"region": f["region"].to_numpy()[first], "zone": f["zone"].to_numpy()[first], "rings": found})

    # Regions are many and small: a group holds those of one part by number, not one of them.
    lines = cut(straight(border_edges(found, tile), tile))
    parts = max(1, -(-lines.count() // LINES))
    tasks = min(parts, 4 * cells.sparkSession.sparkContext.defaultParallelism)
    grouped = lines.withColumn("_g", F.pmod(F.xxhash64("region"), F.lit(parts))).repartition(tasks, "_g").groupBy("_g")
    shapes = grouped.applyInPandas(traced, "region long, zone long, rings array<array<struct<x: double, y: double>>>")
    return shapes.join(sizes, "region")


def outlines(shapes: DataFrame) -> DataFrame:
    """The same polygons without their holes."""
    return shapes.withColumn("rings", F.slice("rings", 1, 1))


def zone_maps(shapes: DataFrame) -> DataFrame:
    """(zone, parts): of each zone the outer rings of its regions, as one multipolygon."""
    return shapes.groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("region", F.col("rings")[0].alias("ring")))).alias("_p")).select("zone", F.transform("_p", lambda p: p["ring"]).alias("parts"))


def multipolygon(parts: str = "parts"):
    """GeoJSON text of parts ARRAY<ARRAY<STRUCT<x, y>>>, each an outer ring, closed."""
    closed = F.transform(parts, lambda r: F.array(F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p["x"], p["y"]))))
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), closed.alias("coordinates")))


def filled(shapes: DataFrame, min_x: float = 0.0, min_y: float = 0.0, step: float = 1.0) -> DataFrame:
    """(row_idx, col_idx, zone) of the cells within polygons (region, zone, rings) made of cells, holes as the rings say. The
    sides that run up and down tell, row by row, where the stretches of a polygon begin and end."""
    sides = edges_of_rings(shapes, "region").filter("x1 = x2")
    row = lambda f: F.round((f("y1", "y2") - min_y) / step + 0.5).cast("long")
    at = sides.select("zone_id", F.round((F.col("x1") - min_x) / step + 0.5).cast("long").alias("_x"), F.explode(F.sequence(row(F.least), row(F.greatest) - 1)).alias("row_idx"))
    rows = at.groupBy("zone_id", "row_idx").agg(F.array_sort(F.collect_list("_x")).alias("_x"))
    pairs = F.explode(F.sequence(F.lit(0), F.size("_x") - 1, F.lit(2))).alias("_i")
    runs = rows.select("zone_id", "row_idx", "_x", pairs).select("zone_id", "row_idx", F.explode(F.sequence(F.col("_x")[F.col("_i")], F.col("_x")[F.col("_i") + 1] - 1)).alias("col_idx"))
    return runs.join(shapes.select(F.col("region").alias("zone_id"), "zone"), "zone_id").select("row_idx", "col_idx", "zone").distinct()


def near(mask: np.ndarray, radius: float) -> np.ndarray:
    """Cells at most radius away from a cell of the mask: exact squared distances by rows, then by columns."""
    reach = int(radius)
    far = mask.shape[0] + mask.shape[1] + reach
    place = np.arange(mask.shape[1])
    behind = place - np.maximum.accumulate(np.where(mask, place, -far), axis=1)
    ahead = np.minimum.accumulate(np.where(mask, place, 2 * far)[:, ::-1], axis=1)[:, ::-1] - place
    along = np.minimum(behind, ahead).astype(np.int64) ** 2
    best = along.copy()
    for k in range(1, reach + 1):
        best[k:] = np.minimum(best[k:], along[:-k] + k * k)
        best[:-k] = np.minimum(best[:-k], along[k:] + k * k)
    return best <= radius * radius


def smooth(cells: DataFrame, radius: float = 2.0, tile: int = TILE) -> DataFrame:
    """(row_idx, col_idx, zone) after each zone has grown by radius cells and shrunk by as much again: gaps and bays
    narrower than twice the radius are closed. A cell may then be in several zones; zones never lose a cell."""
    halo = 2 * int(np.ceil(radius))
    once = cells.filter("zone is not null").select(F.col("row_idx").cast("long").alias("row_idx"), F.col("col_idx").cast("long").alias("col_idx"), F.col("zone").cast("long").alias("zone"))
    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)))
    shared = once.withColumn("_ty", spread("row_idx")).withColumn("_tx", spread("col_idx"))

    def closed(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        top, left, size = key[0] * tile - halo, key[1] * tile - halo, tile + 2 * halo
        out = []
        for zone, own in f.groupby("zone"):
            mask = np.zeros((size, size), bool)
            mask[own["row_idx"] - top, own["col_idx"] - left] = True
            # Beyond the halo nothing is known of the grown zone, and nothing there is within reach of the tile.
            kept = ~near(~near(mask, radius), radius) | mask
            y, x = np.nonzero(kept[halo : size - halo, halo : size - halo])
            out.append(pd.DataFrame({"row_idx": y + top + halo, "col_idx": x + left + halo, "zone": zone}))
        return pd.concat(out)

    return shared.groupBy("_ty", "_tx").applyInPandas(closed, "row_idx long, col_idx long, zone long")
