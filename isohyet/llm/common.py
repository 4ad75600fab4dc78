"""Shared helpers: input normalisation, Arrow batching, shared-folder tables and vectorised text hashes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"
ROWS_PER_BATCH, BYTES_PER_BATCH = 1000, 1 << 20
HASHED_BYTES = 1 << 18  # of text that a worker hashes at once; it holds some eighty times as much meanwhile


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch_size(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts fill neither a Python worker nor the executor's buffers."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    if not 0 < _bytes_per_batch(spark) <= BYTES_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def _bytes_per_batch(spark: SparkSession) -> int:
    found = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(found))


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function for mapInArrow after which the worker gives free memory back. Workers outlive their tasks, and what one
    has held for a moment would stay its own, beside whatever the executor needs next."""

    @functools.wraps(run)
    def tidied(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def narrow(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id BIGINT, text STRING): extra columns, whatever their names, are left out here."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, a local session gets one of its own; on a cluster that is
    an error, as every executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = LOCAL_CHECKPOINTS
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_made: list[str] = []


def new_folder(spark: SparkSession, what: str) -> str:
    _made.append(f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}")
    return _made[-1]


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application, once no result needs them; returns how many there were."""
    _delete(spark, _made)
    n = len(_made)
    _made.clear()
    return n


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are written inside are deleted at the end, but those written by the function that this gives."""
    first, kept = len(_made), set()

    def keep(df: DataFrame, what: str) -> DataFrame:
        out = written(df, what)
        kept.add(_made[-1])
        return out

    try:
        yield keep
    finally:
        own = _made[first:]
        del _made[first:]
        _made.extend(p for p in own if p in kept)
        _delete(spark, [p for p in own if p not in kept])


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it again."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(name: str, taken: Iterable[str]) -> str:
    """A column name that none of those taken has, whatever their case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def slices(batches: Iterable[pa.RecordBatch], most_bytes: int = 4 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cut record batches into pieces of about most_bytes; a longer row stands alone."""
    for batch in batches:
        at = 0
        rows_each = max(1, min(most_rows, int(most_bytes * batch.num_rows / max(1, batch.nbytes))))
        while at < batch.num_rows:
            piece = batch.slice(at, rows_each)
            at += piece.num_rows
            yield piece


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; a null row is empty."""
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    filled = column.fill_null("") if column.null_count else column
    filled = pa.concat_arrays([filled])
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


# --- Polynomial hashes of any substring, from one pass of prefix sums, at two points modulo the prime 2**31 - 1. ---

_PRIME = np.uint64((1 << 31) - 1)
_SHIFT = np.uint64(31)
#: Two points drawn at random: two strings of n letters that differ agree at one of them with a probability of n / 2**31 at most.
_POINTS = [int(x) for x in np.random.default_rng(20240229).integers(1 << 20, (1 << 31) - 1, 2)]
_powers: dict = {"size": 0}


def _folded(x: np.ndarray) -> np.ndarray:
    """A number of the same residue: under 2**34 for any, under 2**32 for those under 2**62."""
    return (x & _PRIME) + (x >> _SHIFT)


def _residue(x: np.ndarray) -> np.ndarray:
    x = _folded(_folded(x))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _power_table(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of both points, the powers and those of the inverse, as far as n."""
    size = 1 << max(16, int(n).bit_length())
    if _powers["size"] < size:
        tables = []
        for point in _POINTS:
            pair = []
            for base in (point, pow(point, -1, int(_PRIME))):
                grown, factor = np.ones(1, np.uint64), base
                while len(grown) < size:
                    grown = np.concatenate([grown, _residue(grown * np.uint64(factor))])
                    factor = factor * factor % int(_PRIME)
                pair.append(grown.astype(np.uint32))
            tables.append(tuple(pair))
        _powers.update(size=size, tables=tables)
    return _powers["tables"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values, so that their order is as good as random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SubstringHash:
    """62-bit hashes of substrings of one array of bytes, or of 64-bit values: equal strings, equal hashes, wherever they
    start."""

    def __init__(self, raw: np.ndarray):
        self.down, self.sums = [], []
        # Bytes are letters of both polynomials; of longer values each has another half.
        letters = [raw.astype(np.uint64) + np.uint64(1)] * 2 if raw.dtype == np.uint8 else [raw & _PRIME, raw >> np.uint64(33)]
        for own, (up, down) in zip(letters, _power_table(len(raw) + 1), strict=True):
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_folded(own * up[: len(raw)]), out=sums[1:])  # terms under 2**32
            self.sums.append(sums)
            self.down.append(down)

    @staticmethod
    def _joined(parts: list[np.ndarray], length: np.ndarray | np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((parts[0] << _SHIFT | parts[1]) + length * np.uint64(0xD6E8FEB86659FD93))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._joined([_residue(_folded(_folded(s[end] - s[start])) * d[start]) for s, d in zip(self.sums, self.down, strict=True)], (end - start).astype(np.uint64))

    def sliding(self, width: int) -> np.ndarray:
        """Hashes of all substrings of one width, by start."""
        n = len(self.sums[0]) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return self._joined([_residue(_folded(_folded(s[width:] - s[:n])) * d[:n]) for s, d in zip(self.sums, self.down, strict=True)], np.uint64(width))


def tokenizer_path(name: str) -> str:
    """A public vocabulary file by name; a path is taken as it stands."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
