"""Points, polygons and grids. Polygons are edge tables (zone_id, x1, y1, x2, y2); points are (loc_id, lat, lon).

Spark has no spatial join. Each polygon is cut into square tiles whose side, a power of two, comes from its own box and
number of edges, so that a tile holds a bounded share of them; points meet the polygons of their tile of every side in use
by an equi-join, and the crossing number of a ray to the east decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.operators.lineage import cut

EDGES_A_BAND = 32
MOST_BANDS = 64  # of a polygon; one of more edges has more of them in a band
LEVELS = (-24, 10)  # the least and largest side of a tile, as powers of two
MOST_BROADCAST = 100_000  # rows that are sent to all tasks at most


def checked(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A table to be broadcast if it is small; else Spark chooses."""
    return F.broadcast(df) if df.count() <= most else df


def edges_of_rings(zones: DataFrame, zone: str = "zone_id", rings: str = "rings") -> DataFrame:
    """Edges of zones with rings ARRAY<ARRAY<STRUCT<x, y>>>; open rings are closed."""
    ring = zones.select(F.col(zone).alias("zone_id"), F.explode(rings).alias("r"))
    closed = F.concat("r", F.slice("r", F.lit(1), F.lit(1)))
    pairs = F.explode(F.arrays_zip(closed.alias("p"), F.slice(closed, F.lit(2), F.size("r")).alias("q"))).alias("e")
    e = ring.select("zone_id", pairs).select("zone_id", F.col("e.p").alias("p"), F.col("e.q").alias("q")).filter("q is not null")
    return e.select("zone_id", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))


def boxes(edges: DataFrame) -> DataFrame:
    return _sized(edges).drop("_n")


def _sized(edges: DataFrame) -> DataFrame:
    """The box of each polygon, and its number of edges."""
    low = lambda a, b: F.min(F.least(a, b))
    high = lambda a, b: F.max(F.greatest(a, b))
    return edges.groupBy("zone_id").agg(low("x1", "x2").alias("min_x"), low("y1", "y2").alias("min_y"), high("x1", "x2").alias("max_x"), high("y1", "y2").alias("max_y"), F.count(F.lit(1)).alias("_n"))


def level_of(extent: Column, edges: Column) -> Column:
    """The side of a polygon's tiles, as a power of two, from the longer side of its box and its number of edges."""
    bands = F.least(F.greatest(edges / EDGES_A_BAND, F.lit(1.0)), F.lit(float(MOST_BANDS)))
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(extent / bands, F.lit(2.0 ** LEVELS[0])))), F.lit(LEVELS[0])), F.lit(LEVELS[1])).cast("int")


def _tile(c: Column, level: Column) -> Column:
    return F.floor(c / F.pow(F.lit(2.0), level))


def levelled(df: DataFrame, levels: DataFrame, x: str = "_x", y: str = "_y") -> DataFrame:
    """Rows with their tile of every side in use: as many rows as there are sides, at most those of LEVELS."""
    out = df.join(F.broadcast(levels), how="cross")
    return out.withColumn("_tx", _tile(F.col(x), F.col("_level"))).withColumn("_ty", _tile(F.col(y), F.col("_level")))


def _crosses(e: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the east from (x, y) crosses an edge."""
    spans = (e["y1"] > y) != (e["y2"] > y)
    return spans & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])


def meetings(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Points with the polygons of their tiles, and the edges that a ray from the point may cross. A band's edges stay
    together as one array, so a point meets a polygon once."""
    box = _sized(edges).withColumn("_level", level_of(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")), F.col("_n")))
    across = F.sequence(_tile(F.col("min_x"), F.col("_level")), _tile(F.col("max_x"), F.col("_level")))
    # A ray to the east meets only edges that reach into its band of y, so each band has its own edges, once for all of
    # the polygon's tiles in it.
    own = edges.join(box.select("zone_id", "_level"), "zone_id")
    low, high = (_tile(f("y1", "y2"), F.col("_level")) for f in (F.least, F.greatest))
    bands = own.withColumn("_ty", F.explode(F.sequence(low, high))).groupBy("zone_id", "_ty").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
    tiled = bands.join(box, "zone_id").withColumn("_tx", F.explode(across))
    at = levelled(points.select("loc_id", F.col("lon").alias("_x"), F.col("lat").alias("_y")), box.select("_level").distinct())
    return at.join(tiled, ["_level", "_tx", "_ty"])


def within(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(loc_id, zone_id) of points inside polygons; a point in several polygons gives several rows."""
    near = meetings(points, edges).filter(F.col("_x").between(F.col("min_x"), F.col("max_x")) & F.col("_y").between(F.col("min_y"), F.col("max_y")))
    return near.filter(F.size(F.filter("_edges", lambda e: _crosses(e, F.col("_x"), F.col("_y")))) % 2 == 1).select("loc_id", "zone_id")


def clip(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of points that lie in any polygon."""
    return points.join(within(points, edges).select("loc_id").distinct(), "loc_id", "left_semi")


def rasterize(cells: DataFrame, edges: DataFrame, times: DataFrame) -> DataFrame:
    """(loc_id, time, zone_id): the polygon of each cell's centre - null outside - for every target time."""
    return cells.select("loc_id").join(within(cells, edges), "loc_id", "left").join(checked(times), how="cross")


def zonal_stats(values: DataFrame, membership: DataFrame, zones: DataFrame) -> DataFrame:
    """min, max, mean and count per zone; zones without a cell stay, with the count 0."""
    cells = values.join(membership, "loc_id").groupBy("zone_id").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.count("value").alias("count"))
    return zones.select("zone_id").distinct().join(cells, "zone_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def zone_means(series: DataFrame, membership: DataFrame) -> DataFrame:
    """Mean of the stations of a zone, for each time."""
    return series.join(membership, "loc_id").groupBy("zone_id", "time").agg(F.avg("value").alias("value"))


def mesh(spark, min_x: float, max_x: float, min_y: float, max_y: float, step: float) -> DataFrame:
    """Grid points keyed by integer row and column; coordinates follow from them."""
    columns, rows = (int(round((b - a) / step)) for a, b in ((min_x, max_x), (min_y, max_y)))
    xs = spark.range(columns + 1).select(F.col("id").cast("int").alias("col_idx"), (F.lit(float(min_x)) + F.col("id") * step).alias("lon"))
    ys = spark.range(rows + 1).select(F.col("id").cast("int").alias("row_idx"), (F.lit(float(min_y)) + F.col("id") * step).alias("lat"))
    return ys.crossJoin(F.broadcast(xs)).select("row_idx", "col_idx", "lat", "lon")  # an axis of a grid, not data


def idw(grid: DataFrame, stations: DataFrame, keys: list[str], most: int = MOST_BROADCAST) -> DataFrame:
    """Inverse-distance weighting; a grid point at a station takes its value, of several the largest.

    Stations travel as arrays of up to `most`: one array, or one a block, whose sums are added up by grid point. No pair
    of a point and a station ever becomes a row."""
    stations = stations.filter("value is not null").select(F.col("lon").alias("_x"), F.col("lat").alias("_y"), F.col("value").alias("_v"))
    blocks = max(1, -(-stations.count() // most))
    block = F.pmod(F.xxhash64("_x", "_y", "_v"), F.lit(blocks)).alias("_b")
    held = stations.groupBy(block).agg(F.collect_list(F.struct("_x", "_y", "_v")).alias("_s"))
    # Each distance is computed once; stations at the point have no weight of their own there, and leave the sums as
    # they are.
    far = F.transform("_s", lambda s: F.struct(F.hypot(s["_x"] - F.col("lon"), s["_y"] - F.col("lat")).alias("d"), s["_v"].alias("v")))
    met = grid.join(F.broadcast(held) if blocks == 1 else held, how="cross").select(*keys, far.alias("_f"))
    on = F.array_max(F.transform(F.filter("_f", lambda f: f["d"] == 0), lambda f: f["v"]))
    added = lambda each: F.aggregate(F.filter("_f", lambda f: f["d"] > 0), F.lit(0.0), lambda a, f: a + each(f))
    near = met.select(*keys, on.alias("_on"), added(lambda f: f["v"] / f["d"]).alias("_t"), added(lambda f: 1 / f["d"]).alias("_w"))
    if blocks > 1:
        near = near.groupBy(*keys).agg(F.max("_on").alias("_on"), F.sum("_t").alias("_t"), F.sum("_w").alias("_w"))
    return near.select(*keys, F.coalesce("_on", F.col("_t") / F.nullif(F.col("_w"), F.lit(0.0))).alias("value"))


def distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """Planar distances in degrees between all pairs of two station lists, the second of checked size."""
    other = b.select(F.col("loc_id").alias("to_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    return a.join(checked(other), how="cross").select("loc_id", "to_id", F.hypot(F.col("lon") - F.col("_lon"), F.col("lat") - F.col("_lat")).alias("distance"))


def positions(grid: DataFrame) -> DataFrame:
    """Adds `pos`, from 1 by latitude from the north, then longitude: rows before a latitude come from a count per
    latitude, an axis of the grid, so only one latitude's points meet in a task."""
    rows = grid.groupBy("lat").agg(F.count(F.lit(1)).alias("_n"))
    before = rows.select("lat", F.coalesce(F.sum("_n").over(Window.orderBy(F.col("lat").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return grid.join(before, "lat").withColumn("pos", F.col("_before") + F.row_number().over(Window.partitionBy("lat").orderBy("lon"))).drop("_before")


def box_meetings(polygons: DataFrame, containers: DataFrame | None = None) -> DataFrame:
    """Polygons with those - or other containers - of their tiles: a container has tiles as large as its box, at most four of them; the contained
    polygon's lower left corner looks in its tile of every side in use."""
    extent = lambda p: F.greatest(F.col(f"{p}max_x") - F.col(f"{p}min_x"), F.col(f"{p}max_y") - F.col(f"{p}min_y"))
    o = (containers or polygons).select(*(F.col(c).alias(f"o_{c}") for c in ("poly_id", "min_x", "min_y", "max_x", "max_y"))).withColumn("_level", level_of(extent("o_"), F.lit(1)))
    for c, t in (("x", "_tx"), ("y", "_ty")):
        o = o.withColumn(t, F.explode(F.sequence(_tile(F.col(f"o_min_{c}"), F.col("_level")), _tile(F.col(f"o_max_{c}"), F.col("_level")))))
    at = levelled(polygons.select("poly_id", "min_x", "min_y", "max_x", "max_y"), o.select("_level").distinct(), "min_x", "min_y")
    return at.join(o, ["_level", "_tx", "_ty"])


def _boxes_within(met: DataFrame) -> DataFrame:
    inside = (F.col("o_min_x") <= F.col("min_x")) & (F.col("o_min_y") <= F.col("min_y")) & (F.col("o_max_x") >= F.col("max_x")) & (F.col("o_max_y") >= F.col("max_y"))
    return met.filter((F.col("poly_id") != F.col("o_poly_id")) & inside)


def box_pairs(polygons: DataFrame, containers: DataFrame | None = None) -> DataFrame:
    """(poly_id, o_poly_id): polygons whose box lies within another's, of the containers if given."""
    return _boxes_within(box_meetings(polygons, containers)).select("poly_id", "o_poly_id")


def contained(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs (poly_id, o_poly_id) whose first polygon lies wholly within the second, sides and corners in common
    allowed: no two edges cross, no corner or middle of an edge lies outside, and an inner point lies inside. edges has
    (zone_id, x1, y1, x2, y2), zone_id being poly_id. A polygon's edges meet those of a partner within its own box only."""
    box = boxes(edges)
    shape = edges.groupBy("zone_id").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_e"))
    own = shape.join(box, "zone_id").withColumnRenamed("zone_id", "poly_id")
    other = shape.select(F.col("zone_id").alias("o_poly_id"), F.col("_e").alias("_o"))
    both = pairs.join(own, "poly_id").join(other, "o_poly_id")
    side = lambda e, x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    among = lambda v, a, b: (v >= F.least(a, b)) & (v <= F.greatest(a, b))

    def outside(x: Column, y: Column) -> Column:
        on = F.exists("_o", lambda o: (side(o, x, y) == 0) & among(x, o["x1"], o["x2"]) & among(y, o["y1"], o["y2"]))
        return ~on & (F.size(F.filter("_o", lambda o: _crosses(o, x, y))) % 2 == 0)

    # Edges of the container that come near the contained polygon; the others cross nothing of it.
    reach = F.filter("_o", lambda o: (F.least(o["x1"], o["x2"]) <= F.col("max_x")) & (F.greatest(o["x1"], o["x2"]) >= F.col("min_x")) & (F.least(o["y1"], o["y2"]) <= F.col("max_y")) & (F.greatest(o["y1"], o["y2"]) >= F.col("min_y")))
    both = both.withColumn("_near", reach)
    apart = lambda a, b: F.signum(a) * F.signum(b) < 0
    cross = F.exists("_e", lambda e: F.exists("_near", lambda o: apart(side(o, e["x1"], e["y1"]), side(o, e["x2"], e["y2"])) & apart(side(e, o["x1"], o["y1"]), side(e, o["x2"], o["y2"]))))
    out = F.exists("_e", lambda e: outside(e["x1"], e["y1"]) | outside((e["x1"] + e["x2"]) / 2, (e["y1"] + e["y2"]) / 2))
    # Half-way between the two lowest heights of corners, the first stretch between two edges is inside.
    heights = F.array_sort(F.array_distinct(F.transform("_e", lambda e: e["y1"])))
    y = (heights[0] + heights[1]) / 2
    xs = F.array_sort(F.transform(F.filter("_e", lambda e: (e["y1"] > y) != (e["y2"] > y)), lambda e: (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    flat = F.size(heights) > 1
    return both.filter(flat & ~cross & ~out & ~outside((xs[0] + xs[1]) / 2, y)).select("poly_id", "o_poly_id")


def small_polygons(polygons: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of polygons (poly_id, zone, min_x, min_y, max_x, max_y), with their outlines in edges (zone_id = poly_id), whose
    box is smaller than another's of their zone and which lie within one of any zone."""
    # Smaller than another of the zone is smaller than the largest: an aggregate by zone, not pairs.
    area = (F.col("max_y") - F.col("min_y")) * (F.col("max_x") - F.col("min_x"))
    sized = polygons.select("poly_id", "zone", area.alias("_area"))
    smaller = sized.join(sized.groupBy("zone").agg(F.max("_area").alias("_most")), "zone").filter("_area < _most").select("poly_id").distinct()
    # Polygons of one outline are one shape: they lie within each other, and within the same others.
    box = ["min_x", "min_y", "max_x", "max_y"]
    outlines = edges.groupBy(F.col("zone_id").alias("poly_id")).agg(F.array_sort(F.collect_list(F.struct("x1", "y1", "x2", "y2"))).alias("_outline"))
    held = cut(polygons.select("poly_id", *box).distinct().join(outlines, "poly_id"))
    shapes = cut(held.groupBy("_outline", *box).agg(F.min("poly_id").alias("_shape"), F.countDistinct("poly_id").alias("_n")))
    members = cut(held.join(smaller, "poly_id", "left_semi").join(shapes, ["_outline", *box]).select("poly_id", "_shape", "_n"))
    every = shapes.select(F.col("_shape").alias("poly_id"), *box)
    asked = members.select(F.col("_shape").alias("poly_id"), "_n").distinct()
    own_edges = cut(edges.join(every.select(F.col("poly_id").alias("zone_id")), "zone_id", "left_semi"))
    tasks = 4 * polygons.sparkSession.sparkContext.defaultParallelism

    def met(sought: DataFrame) -> DataFrame:
        # Few shapes are little data, but many meetings: the tasks must not be put together by size.
        return _boxes_within(box_meetings(sought.repartition(tasks, "poly_id"), checked(every)))

    # The largest box around a shape settles most; only the others look at all that lie around them.
    size = (F.col("o_max_x") - F.col("o_min_x")) * (F.col("o_max_y") - F.col("o_min_y"))
    sought = every.join(asked, "poly_id", "left_semi")
    largest = met(sought).groupBy("poly_id").agg(F.max_by("o_poly_id", size).alias("o_poly_id"))
    copies = asked.filter("_n > 1").select("poly_id", F.col("poly_id").alias("o_poly_id"))
    found = cut(contained(cut(largest.unionByName(copies)), own_edges).select("poly_id").distinct())
    left = cut(sought.join(found, "poly_id", "left_anti"))
    others = contained(met(left).select("poly_id", "o_poly_id"), own_edges).select("poly_id")
    return members.join(found.unionByName(others).withColumnRenamed("poly_id", "_shape"), "_shape", "left_semi").select("poly_id").distinct()


def outward_bounds(df: DataFrame, min_x: str, min_y: str, max_x: str, max_y: str) -> DataFrame:
    """Bounds of all features, one unit outwards: down to whole numbers, up by half-even rounding."""
    down = lambda c: F.min(F.col(c) - 1).cast("int").cast("double")
    up = lambda c: F.bround(F.max(F.col(c) + 0.5), 0)
    return df.agg(down(min_x).alias("min_x"), down(min_y).alias("min_y"), up(max_x).alias("max_x"), up(max_y).alias("max_y"))
