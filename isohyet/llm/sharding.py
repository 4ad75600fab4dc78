"""Sharding by balanced label propagation.

Linked documents - here those of equal text - are joined to one hub of their group, so links grow with the rows. Linked
rows are dealt evenly by a hash. In each round a join brings every linked row its neighbours' shards; a row whose
neighbours mostly lie elsewhere asks to move there. Asks are granted against the places that other asks leave - swaps,
longer rings of shards - and into what unlinked rows hold, as these go wherever there is room at last. Of two linked
rows only one moves in a round, so every move leaves fewer links cut; rounds end when none can be granted. At last
unlinked rows are spread so that counts are at most one apart. `cut_links` counts what stays cut.

Ranks within a shard come from counts of hash slices and a rank within a slice, so no shard's rows meet in one task. A
hub with many links has its label copied over salts, and its links are dealt over them.

Rows: a null text has no bytes and is linked with nothing; empty texts are equal to each other. Repeated rows are
sharded one by one; rows are named by doc_id where it names them, else by a number. Ties between shards go to the smaller number, ties between rows to a hash, then the smaller id.
Fewer rows than shards leave shards empty; an empty table gives an empty table. Extra columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.llm.common import narrow, written

SHARDS, SLICES = 24, 64
HEAVY, SALTS = 10_000, 64  # links of a row from which on its label is copied, and how often


def _hash(*columns: Column | str, salt: int = 0) -> Column:
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in columns], F.lit(salt))


def _salts(heavy: Column, salts: int = SALTS) -> Column:
    """One row, or one for each salt."""
    return F.explode(F.sequence(F.lit(0), F.when(heavy, F.lit(salts - 1)).otherwise(F.lit(0)))).alias("salt")


def _salt(key: str, heavy: Column, salts: int = SALTS) -> Column:
    return F.when(heavy, F.pmod(_hash(key, salt=3), F.lit(salts))).otherwise(F.lit(0)).cast("int").alias("salt")


def links_of_equal_texts(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(src, dst) in both directions between each row and the hub of its group, for rows (row, text_key)."""
    hubs = rows.filter("text_key is not null").groupBy("text_key").agg(F.min("row").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    hubs = hubs.select("text_key", "hub", _salts(F.lit(True), salts))
    pairs = rows.withColumn("salt", _salt("row", F.lit(True), salts)).join(hubs, ["text_key", "salt"]).filter("row <> hub").select("row", "hub")
    return pairs.select(F.col("row").alias("src"), F.col("hub").alias("dst")).unionByName(pairs.select(F.col("hub").alias("src"), F.col("row").alias("dst")))


def ranked(df: DataFrame, group: str, first: list[Column], key: str, slices: int = SLICES) -> DataFrame:
    """Adds `rank`, gapless from 0 within each group, by the order of `first` (integers), then of a hash."""
    cut = df.withColumn("_slice", F.pmod(_hash(key, salt=7), F.lit(slices)))
    order = [*(f"_o{i}" for i in range(len(first))), "_slice"]
    cut = cut.withColumns({f"_o{i}": c for i, c in enumerate(first)})
    sizes = cut.groupBy(group, *order).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    # `before` has at most (groups x orders x slices) rows, whatever the input.
    within = cut.withColumn("_within", F.row_number().over(Window.partitionBy(group, *order).orderBy(_hash(key, salt=11), key)) - 1)
    placed = within.join(F.broadcast(before), [group, *order])
    return placed.withColumn("rank", (F.coalesce("_before", F.lit(0)) + F.col("_within")).cast("long")).drop(*order, "_before", "_within")


def _ring(asks: np.ndarray) -> list[int]:
    """Shards of which each has asks to the next and the last to the first; none if there is no such ring."""
    alive = np.ones(len(asks), bool)
    while (shut := alive & ~(asks[:, alive] > 0).any(axis=1)).any():
        alive &= ~shut
    path = [int(np.argmax(alive))] if alive.any() else []
    while path:
        after = int(np.argmax(np.where(alive, asks[path[-1]], -1)))
        if after in path:
            return path[path.index(after) :]
        path.append(after)
    return path


def grants(asks: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many of the asks [from, to] are granted, where no shard may gain more rows than it has room: swaps, then
    rings, then chains that end in a free place. No further ask could be granted beside them."""
    left = asks - np.minimum(asks, asks.T)
    while ring := _ring(left):
        steps = ring, [*ring[1:], ring[0]]
        left[steps] -= left[steps].min()
    # Without rings, shards come after all those that their rows ask for, so their room is known by then.
    room, ahead = np.maximum(room, 0), np.ones(len(asks), bool)
    while (ready := ahead & ~(left[:, ahead] > 0).any(axis=1)).any():
        for to in np.flatnonzero(ready):
            for source in np.argsort(-left[:, to], kind="stable"):
                n = min(left[source, to], room[to])
                left[source, to] -= n
                room[to] -= n
                room[source] += n
        ahead &= ~ready
    return asks - left


def propagate(rows: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """(row, shard) for all rows, after the given rounds or when no ask can be granted; links are (src, dst) in both
    directions. No shard has more linked rows than its even size."""
    quota = rows.count() // shards
    degrees = links.groupBy(F.col("src").alias("row")).agg(F.count(F.lit(1)).alias("degree"))
    dealt = ranked(degrees.withColumn("_all", F.lit(0)), "_all", [], "row", shards * SLICES)
    labels = written(dealt.select("row", F.pmod("rank", F.lit(shards)).cast("int").alias("shard"), "degree"), "shards")
    pair = F.col("shard") * shards + F.col("target")
    hubs = degrees.filter(F.col("degree") >= heavy).select(F.col("row").alias("dst"), F.lit(True).alias("hub"))  # at most rows / heavy
    salted = links.join(hubs, "dst", "left").select("src", "dst", _salt("src", F.coalesce("hub", F.lit(False))))
    links = written(salted, "links") if not hubs.isEmpty() else links.withColumn("salt", F.lit(0))
    done = idle = 0
    # Rows with many links go first, then those with few, then any; asks that three such rounds leave cannot be granted.
    while idle < 3 and (rounds is None or done < rounds):
        turn = lambda row: F.struct((F.lit((1, -1, 0)[done % 3]) * F.col("degree")).alias("first"), _hash(row, salt=done).alias("then"), F.col(row).alias("name"))  # noqa: B023, E731
        near = links.join(labels.select(F.col("row").alias("dst"), F.col("shard").alias("near"), turn("row").alias("turn"), _salts(F.col("degree") >= heavy)), ["dst", "salt"]).groupBy("src", "near").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("turn"))
        own = near.join(labels.withColumnRenamed("row", "src"), "src")
        want = own.groupBy("src", "shard", "degree").agg(
            F.max(F.struct("n", (-F.col("near")).alias("minus"))).alias("best"), F.max(F.when(F.col("near") == F.col("shard"), F.col("n")).otherwise(0)).alias("here"), F.max("turn").alias("others")
        )
        gain = want.filter(F.col("best.n") > F.col("here")).select(F.col("src").alias("row"), "shard", (-F.col("best.minus")).alias("target"), (F.col("best.n") - F.col("here")).alias("gain"), (turn("src") > F.col("others")).alias("turn"))
        asks = written(gain.withColumn("pair", pair), "asks")
        asked, held = np.zeros((shards, shards), np.int64), np.zeros(shards, np.int64)
        counts = asks.groupBy("shard", "target").agg(F.count_if("turn").alias("n")).collect()  # at most one a pair of shards
        if not counts:
            break
        for r in counts:
            asked[r["shard"], r["target"]] = r["n"]
        for r in labels.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect():
            held[r["shard"]] = r["n"]
        granted = grants(asked, quota - held)
        done, idle = done + 1, 0 if granted.any() else idle + 1
        if not granted.any():
            continue
        limits = rows.sparkSession.createDataFrame([(int(i), int(n), bool(n == m)) for i, (n, m) in enumerate(zip(granted.ravel(), asked.ravel(), strict=True)) if n], "pair int, limit long, whole boolean")
        some = asks.filter("turn").join(F.broadcast(limits), "pair")
        part = ranked(some.filter("not whole"), "pair", [-F.least("gain", F.lit(8))], "row", 8).filter("rank < limit")
        moves = some.filter("whole").select("row", "target").unionByName(part.select("row", "target"))
        labels = written(labels.join(moves, "row", "left").select("row", F.coalesce("target", "shard").cast("int").alias("shard"), "degree"), "shards")
    free = rows.select("row").join(labels, "row", "left_anti").select("row", F.pmod(_hash("row"), F.lit(shards)).cast("int").alias("shard"))
    return written(labels.select("row", "shard").unionByName(free), "shards")


def cut_links(links: DataFrame, placed: DataFrame) -> tuple[int, int]:
    """How many links, each counted once, join rows of different shards, and how many links there are."""
    at = placed.select("row", "shard")
    both = links.filter("src < dst").join(at.withColumnsRenamed({"row": "src", "shard": "_src"}), "src").join(at.withColumnsRenamed({"row": "dst", "shard": "_dst"}), "dst")
    found = both.agg(F.count_if(F.col("_src") != F.col("_dst")).alias("cut"), F.count(F.lit(1)).alias("n")).first()
    return found["cut"], found["n"]


def even(labels: DataFrame, linked: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(row, shard, slot) with counts at most one apart; `linked` holds the rows that have links."""
    sized = labels.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["shard"]: r["n"] for r in sized.collect()}  # one number a shard
    total = sum(sizes.values())
    # The larger of the two sizes go to the fullest shards.
    fullest = sorted(range(shards), key=lambda s: (-sizes.get(s, 0), s))
    target = {s: total // shards + (i < total % shards) for i, s in enumerate(fullest)}
    marked = labels.join(linked.select("row", F.lit(0).alias("_free")).distinct(), "row", "left").withColumn("_free", F.coalesce("_free", F.lit(1)))
    placed = ranked(marked, "shard", [F.col("_free")], "row").drop("_free")
    limit = F.create_map(*[F.lit(x) for s in range(shards) for x in (s, target[s])])
    over, gaps = {}, []
    extra = 0
    for s in range(shards):
        over[s] = extra
        extra += max(0, sizes.get(s, 0) - target[s])
    at = 0
    for s in range(shards):
        lack = max(0, target[s] - sizes.get(s, 0))
        if lack:
            gaps.append((at, at + lack, s, sizes.get(s, 0)))
            at += lack
    first = F.create_map(*[F.lit(x) for s in range(shards) for x in (s, over[s])])
    number = F.col("rank") - limit[F.col("shard")] + first[F.col("shard")]
    shard, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for start, end, s, held in gaps:
        inside = (number >= start) & (number < end)
        shard, slot = F.when(inside, F.lit(s)).otherwise(shard), F.when(inside, number - start + held).otherwise(slot)
    stays = F.col("rank") < limit[F.col("shard")]
    return placed.select("row", F.when(stays, F.col("shard")).otherwise(shard).cast("int").alias("shard"), F.when(stays, F.col("rank")).otherwise(slot).cast("long").alias("slot"))


def named(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, size, text_crc32, text_key): `row` is the doc_id if that names every row, else a number of its own."""
    rows = narrow(df, id_col, text_col).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.sha2("text", 256).alias("text_key")
    )
    rows = written(rows.withColumn("number", F.monotonically_increasing_id()), "documents")
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    return rows.withColumnRenamed("number", "row") if n["ids"] < n["rows"] else rows.drop("number").withColumn("row", F.col("doc_id"))


def shard(df: DataFrame, shards: int = SHARDS, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of df."""
    rows = named(df, id_col, text_col)
    links = written(links_of_equal_texts(rows), "links")
    placed = even(propagate(rows, links, shards, rounds), links.select(F.col("src").alias("row")), shards)
    return rows.join(placed, "row").select("doc_id", "size", "text_crc32", "shard", "slot")
