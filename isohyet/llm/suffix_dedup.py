"""Removal of repeated substrings with a sparse suffix array.

Every byte that a string of `width` bytes covers is removed if that string also starts anywhere else. Suffixes are
compared by leading tokens, 64-bit hashes of stretches of text, at three grains:

1. Each window of `width` bytes is tied to the position in it whose following `context` bytes have the smallest hash;
   equal windows choose equal positions. Windows that share a position are one suffix entry with two leading tokens:
   the bytes after the position, and all bytes of these windows.
2. Entries whose first token occurs elsewhere but whose second does not are cut into bands of `band` windows, again
   with two tokens: the bytes that all windows of the band share, and all bytes of the band.
3. Bands with only the first token in common are cut into their windows.

At each grain the entries are sorted as a suffix array: Spark samples splitters and range-partitions the entries by
their tokens, each bucket is sorted by multikey quicksort - ties on one token alone go on to the next - and neighbours
are compared, across the boundaries of buckets too. Position and id end the key, so that a passage with many copies is
spread over buckets, and comparing with neighbours needs no group in one task: only the first and the last entry of each
bucket are counted by token over all buckets. A token in common on the second place settles an entry with all its
windows; one of each such kind still meets the unsettled ones at the next grain.

Where asked for, the same is done with words instead of bytes: what a window of so many words covers, with the white
space after each, is removed if these words also stand in a row anywhere else, whatever the white space between them.
Words are runs of characters other than ASCII white space, in the case that they have.

Two different stretches have the same token with a probability of about 2**-64.

Rows: a null or empty text has no bytes, and one shorter than the width loses nothing. Rows are told apart by id and
text, so repeated rows - and rows without an id - count as different documents. An empty table gives an empty table.
Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isohyet.llm.common import BYTES_PER_BATCH, HASHED_BYTES, SubstringHash, batch_size, byte_view, scratch, slices, tidy, written

WIDTH, CONTEXT, BAND = 400, 100, 16
WORD_CONTEXT, WORD_BAND = 13, 8  # at most, for windows of words
BUCKET_ROWS = 200_000
BUCKET_SLICE = 1 << 14  # rows of a sorted bucket that are handed on at once
MOST_TASKS = 20_000  # buckets that have a task each; of more of them, several share a task, in which Spark sorts first
MOST_BROADCAST = 250_000  # row names that are sent to all tasks at most; beyond that, a shuffle does it
ENTRY = "d long, m long, lo int, hi int, p int, t1 long, t2 long"
NAMES = [c.split()[0] for c in ENTRY.split(", ")]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_ends(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the texts in a byte array begin and end."""
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    word = ~_SPACE[raw]
    return np.flatnonzero(word & (edge[:-1] | np.append(True, ~word[:-1]))), np.flatnonzero(word & (edge[1:] | np.append(~word[1:], True))) + 1


def _units(column: pa.Array, by_word: bool) -> tuple[SubstringHash, np.ndarray]:
    """Hashes over the bytes or the words of a string column, and the n + 1 offsets of its rows."""
    raw, offsets = byte_view(column)
    hashed = SubstringHash(raw)
    if not by_word:
        return hashed, offsets
    begin, end = word_ends(raw, offsets)
    return SubstringHash(hashed.of(begin, end)), np.searchsorted(begin, offsets)


def _named(df: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """(d, m, doc_id, text, rest): rows are named by id and a hash of the text; rest holds the columns to carry."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.struct(*(F.col(c) for c in carry or [id_col])).alias("rest"))
    return rows.select(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("d"), F.xxhash64("text").alias("m"), "doc_id", "text", "rest")


def smallest_in_windows(values: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each `size` values in a row, by first of them."""
    n = len(values) - size + 1
    if n <= 0:
        return values[:0]
    whole = np.full(-(-len(values) // size) * size, np.iinfo(values.dtype).max, values.dtype)
    whole[: len(values)] = values
    blocks = whole.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[size - 1 : size - 1 + n])


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def entries(df: DataFrame, width: int = WIDTH, context: int = CONTEXT, by_word: bool = False) -> DataFrame:
    """Suffix entries of all windows: starts lo to hi, chosen position p, tokens t1 and t2. df has (d, m, text)."""
    reach = width - context + 1

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, HASHED_BYTES):
            hashed, offsets = _units(b["text"], by_word)
            length = int(offsets[-1])
            if length < width:
                continue
            order = (hashed.sliding(context) & np.uint64(0xFFFFFFFF00000000)) | np.arange(length - context + 1, dtype=np.uint64)
            chosen = (smallest_in_windows(order, reach) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            del order
            sizes = np.diff(offsets)
            inside = np.zeros(length + 1, np.int8)  # of a document, as the start of a window
            held = sizes >= width
            np.add.at(inside, offsets[:-1][held], 1)
            np.add.at(inside, offsets[1:][held] - width + 1, -1)
            valid = np.cumsum(inside[:-1], dtype=np.int8)[: len(chosen)] > 0
            start = np.flatnonzero(valid)
            if not len(start):
                continue
            at = chosen[start]
            new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)))
            lo, hi, p = start[new], start[np.append(new[1:], len(start)) - 1], at[new]
            doc = np.searchsorted(offsets, lo, "right") - 1
            base = offsets[doc]
            d, m = (b[x].to_numpy(zero_copy_only=False)[doc] for x in ("d", "m"))
            t1, t2 = _signed(hashed.of(p, p + context)), _signed(hashed.of(lo, hi + width))
            yield _batch(NAMES, d, m, *((x - base).astype(np.int32) for x in (lo, hi, p)), t1, t2)

    batch_size(df.sparkSession)
    return df.select("d", "m", "text").mapInArrow(run, ENTRY)


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by several keys: quicksort by the first, and only ties are sorted by the next."""
    order = np.argsort(columns[0], kind="quicksort")
    key = columns[0][order]
    same = np.append(False, key[1:] == key[:-1])
    for column in columns[1:]:
        tied = same | np.append(same[1:], False)
        at = np.flatnonzero(tied)
        if not len(at):
            break
        run = np.cumsum(~same)[at]
        inner = np.lexsort((column[order[at]], run))
        order[at] = order[at[inner]]
        key = column[order]
        same &= np.append(False, key[1:] == key[:-1])
    return order


def repeated(df: DataFrame, bucket_rows: int = BUCKET_ROWS, most_tasks: int = MOST_TASKS) -> DataFrame:
    """The entries of a written table whose first token occurs elsewhere, with `whole`: whether the second does, and
    `shown`: whether a settled entry stands for its kind at the next grain."""
    spark = df.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // bucket_rows))

    tasks = min(buckets, most_tasks)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        held = 0
        for b in batches:
            if b.num_rows:
                rows.append(b)
                held += b.num_rows
            if tasks < buckets and held >= bucket_rows:
                yield from slices([bucket(rows)], BYTES_PER_BATCH, BUCKET_SLICE)
                rows, held = [], 0
        if rows:
            yield from slices([bucket(rows)], BYTES_PER_BATCH, BUCKET_SLICE)

    def bucket(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = [np.concatenate([b[n].to_numpy() for b in rows]) for n in NAMES]
        order = multikey_order([columns[i] for i in (5, 6, 0, 1, 2)])
        t1, t2 = columns[5][order], columns[6][order]
        first = t1[1:] == t1[:-1]
        both = first & (t2[1:] == t2[:-1])
        seen = np.append(False, first) | np.append(first, False)
        whole = np.append(False, both) | np.append(both, False)
        # One entry of each settled kind goes on to the next grain with the unsettled ones of its first token.
        start = np.flatnonzero(np.append(True, ~first))
        unsettled = np.logical_or.reduceat(~whole, start)
        unsettled[[0, -1]] = True  # more of these may be in the buckets beside
        shown = whole & np.append(True, ~both) & np.repeat(unsettled, np.diff(np.append(start, len(order))))
        edge = np.zeros(len(order), bool)
        edge[[0, -1]] = True
        keep = seen | edge
        return _batch([*NAMES, "seen", "whole", "shown", "edge"], *(c[order[keep]] for c in columns), seen[keep], whole[keep], shown[keep], edge[keep])

    key = ["t1", "t2", "d", "m", "lo"]
    ranged = df.repartitionByRange(tasks, *key)
    ranged = ranged.sortWithinPartitions(*key) if tasks < buckets else ranged
    found = written(ranged.mapInArrow(run, f"{ENTRY}, seen boolean, whole boolean, shown boolean, edge boolean"), "sorted")
    # Equal tokens lie side by side, so those of a bucket's first or last entry that lie beyond it begin or end a bucket too.
    edges = found.filter("edge")
    over = edges.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("_both")).join(edges.groupBy("t1").agg(F.count(F.lit(1)).alias("_first")), "t1")
    met = edges.join(over, ["t1", "t2"]).withColumns({"seen": F.col("seen") | (F.col("_first") > 1), "whole": F.col("whole") | (F.col("_both") > 1), "shown": F.lit(True)})
    columns = [*NAMES, "seen", "whole", "shown"]
    return found.filter("not edge").select(*columns).unionByName(met.select(*columns)).filter("seen").drop("seen")


def _with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(d, m, text, parts): each document that has rows, with all of them. rows must be a written table."""
    lists = rows.groupBy("d", "m").agg(F.collect_list(F.struct("lo", "hi", "p")).alias("parts"))  # no more than a text is long
    names = rows.select("d", "m").distinct()
    few = F.broadcast(names) if names.count() <= MOST_BROADCAST else names
    return docs.select("d", "m", "text").join(few, ["d", "m"], "left_semi").join(lists, ["d", "m"])


def _cut(df: DataFrame, cut, by_word: bool = False) -> DataFrame:
    """Entries made from the parts of each document: cut(hashes, lo, hi, p, base) gives part number and columns."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, HASHED_BYTES):
            hashed, offsets = _units(b["text"], by_word)
            parts = b["parts"]
            sizes = np.diff(parts.offsets.to_numpy())
            flat = parts.flatten()
            doc = np.repeat(np.arange(b.num_rows), sizes)
            base = offsets[doc]
            lo, hi, p = (flat.field(n).to_numpy().astype(np.int64) + base for n in ("lo", "hi", "p"))
            d, m = (b[x].to_numpy(zero_copy_only=False)[doc] for x in ("d", "m"))
            i, low, high, at, t1, t2 = cut(hashed, lo, hi, p)
            yield _batch(NAMES, d[i], m[i], *((x - base[i]).astype(np.int32) for x in (low, high, at)), _signed(t1), _signed(t2))

    batch_size(df.sparkSession)
    return df.mapInArrow(run, ENTRY)


def _counted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: the number of each part, repeated, and 0 .. n - 1 within it."""
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)


def spans(df: DataFrame, width: int = WIDTH, context: int = CONTEXT, band: int = BAND, bucket_rows: int = BUCKET_ROWS, by_word: bool = False) -> DataFrame:
    """(d, m, lo, hi): window starts, first to last, whose windows occur elsewhere. df has (d, m, text)."""

    def bands(hashed: SubstringHash, lo: np.ndarray, hi: np.ndarray, p: np.ndarray):
        first, last = (p - hi) // band, (p - lo) // band
        i, k = _counted(last - first + 1)
        k += first[i]
        at = p[i]
        low, high = np.maximum(lo[i], at - band * k - band + 1), np.minimum(hi[i], at - band * k)
        shared = hashed.of(at - band * k, at - band * k - band + 1 + width)
        with np.errstate(over="ignore"):
            shared = shared + k.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        return i, low, high, at, shared, hashed.of(low, high + width)

    def windows(hashed: SubstringHash, lo: np.ndarray, hi: np.ndarray, p: np.ndarray):
        i, k = _counted(hi - lo + 1)
        start = lo[i] + k
        token = hashed.of(start, start + width)
        return i, start, start, p[i], token, token

    done: list[DataFrame] = []
    found, open_ = None, None
    for n, cut in ((1, None), (2, bands), (3, windows)):
        with scratch(df.sparkSession) as keep:
            cells = entries(df, width, context, by_word) if cut is None else _cut(_with_text(df, open_), cut, by_word)
            found = keep(repeated(written(cells, "entries"), bucket_rows), f"grain{n}")
        done.append(found.filter("whole").select("d", "m", "lo", "hi"))
        if n < 3:
            open_ = written(found.filter("not whole or shown").select("d", "m", "lo", "hi", "p"), "open")
    return done[0].unionByName(done[1]).unionByName(done[2])


def _covered(n: int, low: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the ranges low to end."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, low, 1)
    np.add.at(cover, end, -1)
    return np.cumsum(cover[:-1]) > 0


def remove_repeats(df: DataFrame, width: int = WIDTH, context: int = CONTEXT, band: int = BAND, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, words: int = 0) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept BINARY, text, rest STRUCT) for every row of df.

    The numbers and `kept`, the remaining bytes, are those of windows of `width` bytes; a cut may fall inside a character.
    `text` is what is left as text, without what cuts have left of characters; with `words`, it lacks repeated windows of
    so many words too. `rest` holds the columns named in carry."""
    docs = _named(df, id_col, text_col, carry or [])
    with scratch(df.sparkSession) as keep:
        found = spans(docs, width, context, band, bucket_rows).withColumn("by_word", F.lit(False))
        if words:
            in_words = spans(docs, words, min(WORD_CONTEXT, -(-words // 4)), min(WORD_BAND, -(-words // 4)), bucket_rows, by_word=True)
            found = found.unionByName(in_words.withColumn("by_word", F.lit(True)))
        found = keep(found, "spans")
    lists = found.groupBy("d", "m").agg(F.collect_list(F.struct("lo", "hi", "by_word")).alias("parts"))
    names = found.select("d", "m").distinct()
    few = F.broadcast(names) if names.count() <= MOST_BROADCAST else names

    schema = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, text string").add("rest", docs.schema["rest"].dataType)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw, offsets = byte_view(b["text"])
            parts = b["parts"]
            ends = parts.offsets.to_numpy() - parts.offsets[0].as_py()
            flat = parts.flatten()
            lo, hi = (flat.field(n).to_numpy().astype(np.int64) for n in ("lo", "hi"))
            by_word = flat.field("by_word").to_numpy(zero_copy_only=False).astype(bool)
            removed, runs, kept, left = [], [], [], []
            for i in range(b.num_rows):
                text = raw[offsets[i] : offsets[i + 1]]
                own = slice(ends[i], ends[i + 1])
                low, w = lo[own], by_word[own]
                gone = _covered(len(text), low[~w], hi[own][~w] + width)
                removed.append(int(gone.sum()))
                runs.append(int((gone & ~np.append(False, gone[:-1])).sum()))
                kept.append(text[~gone].tobytes())
                if w.any():
                    begin = np.append(word_ends(text, np.array([0, len(text)]))[0], len(text))
                    begin[0] = 0  # white space before the first word goes with it
                    gone |= _covered(len(text), begin[low[w]], begin[hi[own][w] + words])
                left.append(text[~gone].tobytes().decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), pa.array(left, pa.string()), b["rest"]], [*schema.names]
            )

    cut = docs.join(few, ["d", "m"], "left_semi").join(lists, ["d", "m"]).select("doc_id", "text", "rest", "parts").mapInArrow(run, schema)
    zero = F.lit(0).cast("long")
    intact = docs.join(few, ["d", "m"], "left_anti").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"), "text", "rest")
    return cut.unionByName(intact)
