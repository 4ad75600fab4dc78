"""Toxicity: lattices against all readings, counts against plain loops, scores on disguised and awkward texts."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from isohyet.llm import queries, toxicity
from isohyet.llm.common import byte_view

INSULTS = ["idiot", "moron", "scum", "worthless"]
PLAIN = "the river runs over old stones near a quiet village where people walk slowly in the evening and talk about bread".split()
AWKWARD = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", None), (4, "!!! 123 @@@", "x"), (None, "no id", "x"), (5, "a a a " * 2000, "x"), (5, "a a a " * 2000, "x"), (6, "xx " * 60000, "x"), (7, "Zoooo" + "o" * 9000 + " 1 2 3 梦 é é é é\0end", "x")]
SCHEMA = "doc_id long, text string, score string"


def view(texts):
    return byte_view(pa.array(texts, pa.string()))


@pytest.fixture(scope="module")
def labelled():
    draw = random.Random(7)
    rows = []
    for i in range(600):
        words = [draw.choice(PLAIN) for _ in range(40)]
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            words.insert(draw.randrange(40), draw.choice(INSULTS))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark, labelled):
    docs = spark.createDataFrame([r[:2] for r in labelled], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in labelled], "doc_id long, toxic int, text string")
    return toxicity.fit(docs, labels, toxicity.fit_characters(docs))


def symbol(b):
    c = chr(b)
    return 27 + b % 5 if b >= 128 else ord(c.lower()) - 96 if c.isalpha() else 0


def plain_grams(texts):
    counts = Counter()
    for t in texts:
        s = [0, 0, 0, *map(symbol, t.encode()), 0]
        for i in range(len(s) - 3):
            counts[((s[i] * 32 + s[i + 1]) * 32 + s[i + 2]) * 32 + s[i + 3]] += 1
    return counts


def test_counts_equal_plain_loops(spark, monkeypatch):
    texts = ["", "a", "Über idiots 4 all", "x" * 50, "", "the end."]
    expected = plain_grams(texts)
    for size in (1 << 22, 7):
        monkeypatch.setattr(toxicity, "BLOCK_BYTES", size)
        got = toxicity.grams(*view(texts))
        assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == dict(expected)
    assert toxicity.grams(*view([])).sum() == 0
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    counts = np.zeros(toxicity.CELLS, np.int64)
    for k, n in expected.items():
        counts[k] = n
    assert np.array_equal(toxicity.fit_characters(docs).logs, toxicity.model_of(counts).logs)


def test_probabilities_add_up(model):
    assert np.exp(model.characters.logs.astype(float)).reshape(-1, 32).sum(1) == pytest.approx(np.ones(32**3), abs=1e-4)


def brute(stretch, characters):
    """The likeliest of all readings."""
    best = (-math.inf, b"")
    for choice in itertools.product(*toxicity.lattice(stretch)):
        score, context = 0.0, 0
        for out, price in choice:
            score += price
            for b in out:
                x = context * 32 + symbol(b)
                score += characters.logs[x]
                context = x % 32**3
        score += characters.logs[context * 32]
        if score > best[0]:
            best = (score, b"".join(o for o, _ in choice))
    return best[1]


@pytest.mark.parametrize("stretch", ["1d10t", "m0r0n", "i d i o t", "s.c.u.m", "stuuupid", "w0rthle55", "sc|um", "a b c", "4ll", "ééé", "m0oorr0nn", "@$$", "i d 1 0 t"])
def test_search_equals_all_readings(model, stretch):
    assert toxicity.decode(stretch.encode(), model.characters) == brute(stretch.encode(), model.characters)


def test_disguised_words_are_read(model):
    reader = toxicity.Reader(model.characters)
    texts = ["you 1d10t!", "such a M0R0N, really", "i d i o t", "what sc-u-m", "s.c.u.m", "idiooooot", "plain words stay", "in 2024, 100% of 3 items", ""]
    out, ends = reader.restored(*view(texts))
    starts = [0, *(ends[:-1] + 1)]
    got = [out[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert got == ["you idiot!", "such a moron, really", "idiot", "what sc-u-m", "scum", "idiot", "plain words stay", "in 2024, 100% of 3 items", ""]


def test_restore_keeps_other_texts(spark, model):
    rows = {r["doc_id"]: r["text"] for r in toxicity.restore(spark.createDataFrame(AWKWARD, SCHEMA), model.characters).collect()}
    assert rows[1] == rows[2] == "" and rows[3] == " \n\t " and rows[6] == "xx " * 60000 and rows[None] == "no id"
    assert rows[7].endswith("\0end") and "梦" in rows[7] and rows[7].startswith("zo") and len(rows[7]) < 100


def test_blocks_change_nothing(model, monkeypatch):
    texts = ["you 1d10t and i d i o t, m0r0n\n" * 40, "", "aaa bbb c d e f", "ü" * 30 + " x y z"]
    scorer = toxicity.Scorer(model)
    whole, found = toxicity.stretches(toxicity._LOWER[view(texts)[0]]), scorer.found(*view(texts))
    monkeypatch.setattr(toxicity, "BLOCK_BYTES", 16)
    monkeypatch.setattr(toxicity._blocks, "__defaults__", (16,))
    cut = toxicity.stretches(toxicity._LOWER[view(texts)[0]])
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True)) and all(np.array_equal(a, b) for a, b in zip(found, scorer.found(*view(texts)), strict=True))


def plain_features(text):
    """(beginning, bytes, whole) of the words of a text without signs of disguise, with how often each occurs."""
    words, word = [], b""
    for b in [*text.lower().encode(), 32]:
        if b >= 128 or chr(b).isalpha():
            word += bytes([b])
        elif word:
            words.append(word)
            word = b""
    return Counter((w[:k], k, whole) for w in words for k in range(3, 8) for whole in ((False, True) if len(w) == k else (False,)) if len(w) >= k)


def test_features_equal_plain_loops(model):
    texts = ["the river runs, the River stops", "", "é ñandú über", "ab abc abcd abcdefghij"]
    reader = toxicity.Reader(model.characters)
    docs, values = toxicity.counts_of(toxicity.features(*reader.restored(*view(texts))), len(texts))
    got = Counter(zip(docs.tolist(), values.tolist(), strict=True))
    expected = Counter()
    for i, t in enumerate(texts):
        counts = plain_features(t)
        words = sum(n for (_, k, whole), n in counts.items() if k == 3)
        for (raw, k, whole), n in counts.items():
            value = int.from_bytes(raw.rjust(7, b"\0"), "big") << 8 | k + (toxicity.WHOLE if whole else 0)
            for level, there in enumerate((n >= 1, n >= 2, n >= 4, n > 1 and n * toxicity.FREQUENT >= words)):
                if there:
                    expected[i, value + level * toxicity.LEVEL] += 1
    # Words of seven bytes end where the values of six begin, so beginnings of each length are shifted alike.
    assert got == expected


def test_scores_tell_the_labels_apart(spark, labelled, model):
    held = [(1000 + i, "quiet village bread " + ("you " + w if toxic else "walk slowly"), int(toxic)) for i, (w, toxic) in enumerate([*((w, True) for w in ["idiot scum", "m0ron 1d10t", "w o r t h l e s s scum", "scuuum morooon"]), ("", False)])]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame([r[:2] for r in held], "doc_id long, text string"), model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in held)
    own = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame([r[:2] for r in labelled], "doc_id long, text string"), model).collect()}
    assert np.mean([(own[i] >= 0.5) == bool(y) for i, _, y in labelled]) > 0.99


def test_awkward_rows(spark, model):
    got = toxicity.score(spark.createDataFrame(AWKWARD, SCHEMA), model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[1] == by_id[2] == by_id[3] and [r["score"] for r in got if r["doc_id"] == 5][0] == by_id[5]
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity.score(empty, model).collect() == []
    unlearned = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"), toxicity.fit_characters(empty))
    assert not unlearned.known and {r["score"] for r in toxicity.score(spark.createDataFrame(AWKWARD, SCHEMA), unlearned).collect()} == {0.0}


def test_copies_count_once_and_labels_may_be_missing(spark, labelled):
    docs = spark.createDataFrame([r[:2] for r in labelled] + [(5000 + i, labelled[1][1]) for i in range(500)] + [(9000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled] + [(5000 + i, 0) for i in range(500)] + [(9000, 1), (9001, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    sample = toxicity.sample_of(docs, labels, 10_000)
    assert sample.count() == len({t for _, t, _ in labelled})
    assert toxicity.sample_of(docs, labels, 50).count() < 200


def test_op11_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op11_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in toxic]
    assert np.mean([a == b for a, b in held]) >= 0.98 and len(held) > 500
    assert sum(a and b for a, b in held) >= 0.9 * sum(b for _, b in held)
