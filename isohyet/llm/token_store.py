"""Token ids in binary shards with a minimal perfect hash index.

A shard file holds the raw ids of documents in ascending doc_id order and an index that maps a document key to its
place in constant time: a minimal perfect hash built in levels (a key that is alone in a cell of a level has its place
there, the others go on to the next level), and for each slot a stored fingerprint, offset and length. A key that is
not in the shard meets another fingerprint, and is refused.

Files are written under a task's own name and then renamed, so a lost or repeated task leaves no half file; shards are
listed by a manifest of what the successful tasks wrote.

Rows: a null or empty text has only the end id. Null doc_ids sort first and are stored under a key of their own.
Repeated doc_ids are stored in the order of a hash of their texts, over several shards if need be, and told apart by
their number within a shard. An empty table writes no shards. Extra columns are left out.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isohyet.llm.byte_bpe import VOCABULARY, encoder, vocabulary_path
from isohyet.llm.common import batch_size, mixed, narrow, slices

MAGIC = b"TOKSHRD1"
SHARD_TOKENS = 1 << 22
PARTITION_BYTES = 24 << 20
CELLS_PER_KEY, MOST_LEVELS = 2, 64
_HEAD = struct.Struct("<8sQQQQ")
MANIFEST = "path string, part int, file int, documents long, tokens long, first_id long, last_id long"


def key_of(doc_id: np.ndarray, number: np.ndarray) -> np.ndarray:
    """64-bit keys of (doc_id, number among equal ids)."""
    with np.errstate(over="ignore"):
        return mixed(mixed(doc_id.astype(np.int64).view(np.uint64)) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _cells(keys: np.ndarray, level: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(keys + np.uint64((level + 1) * 0xD1342543DE82EF95 % (1 << 64))) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """key -> 0 .. n - 1 without gaps or clashes, for the keys it was built from."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.cumsum(x, dtype=np.int64) for x in levels]
        before = np.cumsum([0, *(int(c[-1]) for c in counts)])
        self.ranks = [c - 1 + b for c, b in zip(counts, before, strict=False)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            if len(levels) == MOST_LEVELS:
                raise ValueError("two keys have the same 64-bit value")
            n = max(8, CELLS_PER_KEY * len(keys))
            cells = _cells(keys, len(levels), n)
            alone = np.bincount(cells, minlength=n) == 1
            levels.append(alone)
            keys = keys[~alone[cells]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level knows it."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for i, alone in enumerate(self.levels):
            cells = _cells(keys[open_], i, len(alone))
            hit = alone[cells]
            out[open_[hit]] = self.ranks[i][cells[hit]]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        parts = [struct.pack("<I", len(self.levels))]
        for x in self.levels:
            parts += [struct.pack("<Q", len(x)), np.packbits(x).tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        (n,), at, levels = struct.unpack_from("<I", raw), 4, []
        for _ in range(n):
            (size,) = struct.unpack_from("<Q", raw, at)
            body = np.frombuffer(raw, np.uint8, (size + 7) // 8, at + 8)
            levels.append(np.unpackbits(body, count=size).astype(bool))
            at += 8 + len(body)
        return cls(levels)


def pack_shard(doc_ids: list[int | None], numbers: list[int], bodies: list[bytes]) -> bytes:
    """A whole shard file: head, ids of the documents, index, and the token ids, raw and little-endian, in 16 bits each
    where all fit and else in 32. bodies hold 32-bit ids."""
    ids = np.array([0 if d is None else d for d in doc_ids], np.int64)
    nulls = np.array([d is None for d in doc_ids])
    keys = key_of(ids, np.array(numbers, np.int64) + (nulls.astype(np.int64) << 40))
    index = PerfectHash.build(keys)
    lengths = np.array([len(b) // 4 for b in bodies], np.int64)
    slots = np.zeros(len(keys), np.dtype([("mark", "<u4"), ("at", "<u8"), ("n", "<u8")]))
    place = index.slots(keys)
    slots["mark"][place] = (keys >> np.uint64(32)).astype(np.uint32)
    slots["at"][place] = np.cumsum(lengths) - lengths
    slots["n"][place] = lengths
    named = np.zeros(len(keys), np.dtype([("id", "<i8"), ("number", "<u8")]))
    named["id"], named["number"] = ids, np.array(numbers, np.uint64) | (nulls.astype(np.uint64) << np.uint64(40))
    hashed = index.to_bytes()
    payload = np.frombuffer(b"".join(bodies), "<u4")
    width = 4 if len(payload) and payload.max() > 0xFFFF else 2
    return b"".join([_HEAD.pack(MAGIC, len(keys), len(hashed), len(payload), width), named.tobytes(), hashed, slots.tobytes(), payload.astype(f"<u{width}").tobytes()])


class Shard:
    """A shard file that has been read: keyed access in constant time."""

    def __init__(self, raw: bytes):
        magic, n, hashed, tokens, width = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size
        self.named = np.frombuffer(raw, np.dtype([("id", "<i8"), ("number", "<u8")]), n, at)
        at += self.named.nbytes
        self.index = PerfectHash.from_bytes(raw[at : at + hashed])
        at += hashed
        self.slots = np.frombuffer(raw, np.dtype([("mark", "<u4"), ("at", "<u8"), ("n", "<u8")]), n, at)
        self.payload = np.frombuffer(raw, f"<u{width}", tokens, at + self.slots.nbytes)

    def find(self, doc_id: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 where its fingerprint is not the stored one."""
        keys = key_of(doc_id, number)
        place = self.index.slots(keys)
        if len(self.slots):
            place[self.slots["mark"][place] != (keys >> np.uint64(32)).astype(np.uint32)] = -1
        return place

    def tokens(self, slot: int) -> np.ndarray:
        at, n = int(self.slots["at"][slot]), int(self.slots["n"][slot])
        return self.payload[at : at + n].astype("<u4")


def write(df: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = 2, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shard files into a folder that executors share; returns the manifest, one row per shard."""
    path = vocabulary_path(vocabulary)
    end = end_id.to_bytes(4, "little")
    rows = narrow(df, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // PARTITION_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        part = TaskContext.get().partitionId()
        ids, numbers, bodies = [], [], []
        held = file = number = 0
        last: object = run

        def close() -> pa.RecordBatch:
            name = f"{folder}/shard-{part:06d}-{file:04d}.bin"
            put_file(name, pack_shard(ids, numbers, bodies))
            named = [i for i in ids if i is not None]
            values = [name, part, file, len(ids), held, min(named, default=None), max(named, default=None)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4], strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

        for b in slices(batches):
            for key, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                number = number + 1 if key == last else 0
                last = key
                ids.append(key)
                numbers.append(number)
                bodies.append((own.encode(text) if text else b"") + end)
                held += len(bodies[-1]) // 4
                if held >= shard_tokens:
                    yield close()
                    ids, numbers, bodies = [], [], []
                    held, file = 0, file + 1
        if ids:
            yield close()

    batch_size(df.sparkSession)
    key = F.col("doc_id").asc_nulls_first(), F.col("mark").asc()  # so that rows of one id, or of none, can have several ranges
    ordered = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange(parts, *key).sortWithinPartitions(*key, F.col("text").asc_nulls_first()).drop("mark")
    manifest = f"{folder}/manifest"
    ordered.mapInArrow(run, MANIFEST).write.parquet(manifest)
    return df.sparkSession.read.schema(MANIFEST).parquet(manifest)


def put_file(path: str, raw: bytes) -> None:
    """Write a file under a name of its own, then rename it, on any file system that Arrow knows."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    mine = f"{name}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(mine) as f:
        f.write(raw)
    system.move(mine, name)


def read_all(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids BINARY) of every stored document, each found through its shard's index."""
    # One row per shard file: the tokens before a shard are a running sum over the manifest, summed by part first.
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("t"))
    before = parts.withColumn("before", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("inner", inner).join(before, "part").select("path", (F.col("before") + F.col("inner")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for name, base in zip(b["path"].to_pylist(), b["base"].to_pylist(), strict=True):
                system, at = fs.FileSystem.from_uri(name)
                with system.open_input_file(at) as f:
                    shard = Shard(f.read())
                number = shard.named["number"].astype(np.int64)
                place = shard.find(shard.named["id"], number)
                if (place < 0).any():
                    raise ValueError(f"{name}: the index does not know all of its documents")
                for i in range(0, len(place), 512):
                    part = place[i : i + 512]
                    null = number[i : i + 512] >> 40 > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.named["id"][i : i + 512], pa.int64(), mask=null), pa.array(base + shard.slots["at"][part].astype(np.int64)), pa.array([shard.tokens(s).tobytes() for s in part], pa.binary())],
                        ["doc_id", "start", "ids"],
                    )

    return placed.repartition(F.col("path")).mapInArrow(run, "doc_id long, start long, ids binary")


def lookup(manifest: DataFrame, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids BINARY) of the first document stored under each wanted key; unknown keys give null ids.

    Keys are matched to shards by id range, then each shard answers for its keys in constant time a key."""
    wanted = keys.select(F.col(id_col).cast("long").alias("doc_id"))
    spans = manifest.select("path", "first_id", "last_id").filter("first_id is not null")
    # One row per shard file. The first document of an id lies in the first shard that ends with that id or a later one.
    span_rows = sorted((r["last_id"], r["first_id"], r["path"]) for r in spans.collect())
    ends, paths = np.array([s for s, _, _ in span_rows], np.int64), [p for _, _, p in span_rows]

    def to_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.array([0 if x is None else x for x in b["doc_id"].to_pylist()], np.int64)
            at = np.searchsorted(ends, ids, "left")
            known = b["doc_id"].is_valid().to_pylist()
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([paths[i] if k and i < len(paths) else None for i, k in zip(at, known, strict=True)], pa.string())], ["doc_id", "path"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        open_: dict[str, Shard] = {}
        for b in batches:
            out = []
            for key, name in zip(b["doc_id"].to_pylist(), b["path"].to_pylist(), strict=True):
                if name is None:
                    out.append(None)
                    continue
                if name not in open_:
                    open_.clear()
                    system, at = fs.FileSystem.from_uri(name)
                    with system.open_input_file(at) as f:
                        open_[name] = Shard(f.read())
                place = open_[name].find(np.array([key], np.int64), np.zeros(1, np.int64))[0]
                out.append(None if place < 0 else open_[name].tokens(place).tobytes())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, pa.binary())], ["doc_id", "ids"])

    by_shard = wanted.mapInArrow(to_shard, "doc_id long, path string").repartition("path", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("path")
    return by_shard.mapInArrow(answer, "doc_id long, ids binary")
