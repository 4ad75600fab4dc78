"""What tasks with Python hold and hand on at once doesn't grow with their rows, and a worker keeps nothing of it."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isohyet.llm import common, packing, suffix_dedup


def sizes_of(df):
    """(rows, bytes) of the batches that the function of a query gets."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    return df.mapInArrow(run, "n long, size long").collect()


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    common.batch_size(spark)
    df = spark.range(400, numPartitions=1).select("id", F.repeat(F.lit("lorem "), 10_000).alias("text"))
    got = sizes_of(df)
    assert sum(r["n"] for r in got) == 400
    assert max(r["size"] for r in got) < 3 * common.BYTES_PER_BATCH


def handed_on(monkeypatch, module, call):
    """The batches that the function given to mapInArrow hands on."""
    held = []
    monkeypatch.setattr(module, "tidy", lambda f: held.append(f) or f)
    call()
    return held[-1]


def test_pieces_are_handed_on_in_small_batches(spark, monkeypatch):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    run = handed_on(monkeypatch, packing, lambda: packing.pack(df))
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    text = " ".join(f"word{i}" for i in range(400_000))
    got = list(run([pa.record_batch({"doc_id": [7], "text": [text]})]))
    assert max(b.nbytes for b in got) < 4 << 20
    pieces = sorted((s, n) for b in got for s, n in zip(b["start"].to_pylist(), b["length"].to_pylist(), strict=True))
    ends = np.cumsum([n for _, n in pieces])
    assert [s for s, _ in pieces] == [0, *ends[:-1]] and ends[-1] == got[0]["doc_tokens"][0].as_py()


def test_sorted_buckets_are_handed_on_in_small_batches(spark, monkeypatch):
    n = 100_000
    df = common.written(spark.createDataFrame([], suffix_dedup.ENTRY), "entries")
    run = handed_on(monkeypatch, suffix_dedup, lambda: suffix_dedup.repeated(df))
    token = np.arange(n) // 2
    rows = {"d": np.arange(n), "m": np.arange(n), **{x: np.zeros(n, np.int32) for x in ("lo", "hi", "p")}, "t1": token, "t2": token}
    got = list(run([pa.record_batch(rows)]))
    assert sum(b.num_rows for b in got) == n and all(b["whole"].to_numpy(zero_copy_only=False).all() for b in got)
    assert max(b.nbytes for b in got) <= 2 * common.BYTES_PER_BATCH


def resident():
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) >> 10


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="Linux only")
def test_a_worker_gives_memory_back_after_a_task():
    pins = []

    def run(batches):
        blocks = [bytes(b"x" * 60_000) for _ in range(3000)]
        pins.append(blocks[-1])  # lies above the others, so that they stay with the process when they are freed
        del blocks
        yield resident()

    within = next(iter(got := common.tidy(run)(iter([]))))
    assert list(got) == []
    assert resident() < within - 100
