"""Cost-balanced packing of token sequences.

Each task packs the documents it reads, block by block, so nothing is shuffled and a block's size bounds memory. In
a block the sequences are fixed beforehand: as many full ones as the tokens fill, and for the rest sequences whose
lengths are the powers of two that add up to it, so that no place stays empty. Documents longer than a sequence fill
whole ones; the remaining pieces go, longest first, to the sequence of the lowest cost - tokens plus a quadratic
attention term - that has room. A piece that fits nowhere is cut over the sequences with the most room.

Rows: a null or empty text has only the end id. Repeated rows are packed as often as they occur; ties in length keep
the order of rows, ties in cost go to the first sequence. An empty table has no pieces. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from isohyet.llm.byte_bpe import VOCABULARY, encoder, vocabulary_path
from isohyet.llm.common import batch_size, narrow, slices, tidy

LINEAR, QUADRATIC = 1.0, 1.0 / 2048
PIECES_PER_BATCH = 256  # handed on at once: 2 MB at most of full sequences of 2048
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def assign(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of every piece; each id of each item lies in exactly one piece."""
    whole = int(lengths.sum() // capacity)
    rest = int(lengths.sum() % capacity)
    sizes = [capacity] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    room, cost = np.array(sizes, np.int64), np.zeros(len(sizes))
    pieces, waiting = [], []
    used = 0
    for item, n in enumerate(lengths.tolist()):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((item, start, capacity, used, 0))
            room[used] = 0
            used += 1
        if n % capacity:
            waiting.append((n % capacity, item, n - n % capacity))
    waiting.sort(key=lambda x: (-x[0], x[1]))
    size = np.array(sizes, np.int64)

    def put(item: int, start: int, n: int, at: int) -> None:
        pieces.append((item, start, n, at, int(size[at] - room[at])))
        room[at] -= n
        cost[at] += linear * n + quadratic * n * n

    for n, item, start in waiting:
        fits = room >= n
        if fits.any():
            put(item, start, n, int(np.where(fits, cost, np.inf).argmin()))
            continue
        while n:
            at = int(room.argmax())
            part = min(n, int(room[at]))
            put(item, start, part, at)
            start, n = start + part, n - part
    return pieces


def pack(df: DataFrame, vocabulary: str = VOCABULARY, capacity: int = 2048, end_id: int = 1, block_tokens: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with its little-endian 32-bit ids. A block closes once it holds block_tokens tokens."""
    path = vocabulary_path(vocabulary)
    end = end_id.to_bytes(4, "little")

    def placed(docs: list[tuple[int | None, bytes]], first: int) -> tuple[list[pa.RecordBatch], int]:
        lengths = np.array([len(raw) // 4 for _, raw in docs], np.int64)
        pieces = assign(lengths, capacity)
        out = []
        for i in range(0, len(pieces), PIECES_PER_BATCH):
            part = pieces[i : i + PIECES_PER_BATCH]
            columns = list(zip(*((docs[d][0], s, n, len(docs[d][1]) // 4, first + q, o, docs[d][1][4 * s : 4 * (s + n)]) for d, s, n, q, o in part), strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.binary())]
            out.append(pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SCHEMA.split(", ")]))
        return out, first + 1 + max((p[3] for p in pieces), default=-1)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        first = TaskContext.get().partitionId() << 40  # sequence ids are unique over tasks
        docs, held = [], 0
        for b in slices(batches):
            for key, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                docs.append((key, (own.encode(text) if text else b"") + end))
                held += len(docs[-1][1]) // 4
                if held >= block_tokens:
                    out, first = placed(docs, first)
                    yield from out
                    docs, held = [], 0
        if docs:
            yield from placed(docs, first)[0]
        own.clear()  # the memo; the vocabulary stays

    batch_size(df.sparkSession)
    return narrow(df, id_col, text_col).mapInArrow(run, SCHEMA)
