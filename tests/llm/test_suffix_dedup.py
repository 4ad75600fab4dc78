"""Removal of repeated substrings against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from isohyet.llm import queries, suffix_dedup
from isohyet.llm.common import written


def brute(texts, width):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(hash(x[i : i + width]) for x in raw for i in range(len(x) - width + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x), bool)
        end = 0
        for i in range(len(x) - width + 1):
            if count[hash(x[i : i + width])] > 1:
                gone[max(i, end) : i + width] = True
                end = i + width
        runs = int((gone & ~np.append(False, gone[:-1])).sum())
        out.append((len(x), int(gone.sum()), runs, np.frombuffer(x, np.uint8)[~gone].tobytes()))
    return out


def brute_words(texts, words=51, width=400):
    """What is left of each text without its repeated windows of words and of bytes."""
    raw = [t.encode() for t in texts]
    begin = [[0, *[m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", x)][1:], len(x)] for x in raw]
    split = [x.split() for x in raw]
    in_words = Counter(tuple(w[i : i + words]) for w in split for i in range(len(w) - words + 1))
    in_bytes = Counter(x[i : i + width] for x in raw for i in range(len(x) - width + 1))
    out = []
    for x, b, w in zip(raw, begin, split, strict=True):
        gone = np.zeros(len(x), bool)
        for i in range(len(w) - words + 1):
            if in_words[tuple(w[i : i + words])] > 1:
                gone[b[i] : b[i + words]] = True
        for i in range(len(x) - width + 1):
            if in_bytes[x[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append(np.frombuffer(x, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"))
    return out


def made_texts(seed, width):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [noise(n) for n in (width - 8, width - 2, width, width + 1, 3 * width, 9 * width)]
    texts = [None, "", "x", "a" * (5 * width), "ab" * width, shared[5], shared[5]]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts.append(noise(rng.randint(0, 2 * width)))
            s = rng.choice(shared)
            cut = rng.randint(0, len(s) // 3)
            parts.append(s[cut : len(s) - rng.randint(0, len(s) // 3)])
        texts.append("".join(parts))
    return texts


def test_equals_brute_force(spark):
    for seed, width, context, band in ((1, 40, 12, 4), (2, 60, 20, 16), (3, 400, 100, 16)):
        texts = made_texts(seed, width)
        df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(df, width, context, band, bucket_rows=97).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, width)


def test_buckets_that_share_a_task(spark):
    texts = made_texts(4, 40)
    docs = suffix_dedup._named(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", [])
    cells = written(suffix_dedup.entries(docs, 40, 12), "test")
    one, two = (sorted(map(tuple, suffix_dedup.repeated(cells, bucket_rows=97, most_tasks=n).drop("shown").collect())) for n in (10_000, 3))
    assert one == two and len(one) > 500


def test_op10_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in docs], brute([r["text"] for r in docs], 400), strict=True))
    left = dict(zip([r["doc_id"] for r in docs], brute_words([r["text"] or "" for r in docs]), strict=True))
    got = queries.op10_suffix_dedup(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        n, removed, runs, kept = want[r["doc_id"]]
        assert r["text"] == left[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, removed, runs, hashlib.sha256(kept).hexdigest())


def test_awkward_rows(spark):
    rows = [(None, "q" * 500), (None, "q" * 500), (1, "unique " * 3), (1, "unique " * 3), (2, None), (3, "")]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in got) == sorted([("None", 500, 500)] * 2 + [("1", 21, 0)] * 2 + [("2", 0, 0), ("3", 0, 0)])
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=40))
def test_multikey_order_sorts(rows):
    columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
    assert [rows[i] for i in suffix_dedup.multikey_order(columns)] == sorted(rows)
