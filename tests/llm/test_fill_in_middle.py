"""Fill-in-middle: units against a plain scan, exact round trips, awkward rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from isohyet.llm import fill_in_middle as fim
from isohyet.llm import queries

WS = r"[\x20\x09-\x0D]"
TEXTS = ["", " ", "a", " a", "a ", "  two  words \n", "\t\x0b\x0c\r\n", "é 梦  😀 x y", "x<S>y and more", "a\nb\n\n\nc", "one two three four five six", "no_space-but.signs", "lorem ipsum " * 20000]
AWKWARD = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(50, None, None), (None, "no id here", "x"), (7, TEXTS[10], "x"), (7, TEXTS[10], "x")]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string, `output` string")


def test_units_equal_a_scan(spark, awkward):
    plain = {
        "tokens": lambda t: re.findall(f"{WS}*[^\\x20\\x09-\\x0D]+|{WS}+", t),
        "characters": list,
        "lines": lambda t: t.splitlines(keepends=True) if not re.search("[\x0b\x0c\r\x1c-\x1e\x85  ]", t) else re.findall("[^\n]*\n|[^\n]+", t),
        "classes": lambda t: re.findall(r"\w+|\W+", t),
    }
    for grammar, scan in plain.items():
        for r in awkward.filter("text is not null").select("text", fim.units(F.col("text"), grammar).alias("u")).collect():
            assert r["u"] == scan(r["text"]), (grammar, r["text"][:40])


def expected(key, text, rate=50, spm=80, seed=42):
    text = text or ""
    units = re.findall(f"{WS}*[^\\x20\\x09-\\x0D]+|{WS}+", text)
    h = [int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    return (len(units), "spm", p, m, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(units), "psm", p, m, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 50), (0, 80), (100, 0)])
def test_forms_equal_plain_loops(awkward, rate, spm):
    made = fim.transform(awkward, rate=rate, spm_rate=spm)
    got = sorted((str(r["doc_id"]), r["n"], r["form"], r["prefix"], r["middle"], r["output"]) for r in made.collect())
    want = sorted((str(k), *expected(k, t, rate, spm)) for k, t, _ in AWKWARD)
    assert list(map(str, got)) == list(map(str, want))


@pytest.mark.parametrize("grammar", fim.GRAMMARS)
def test_round_trip(awkward, grammar):
    made = fim.transform(awkward, grammar, rate=100, spm_rate=50)
    assert made.filter(fim.restore(F.col("output"), F.col("form")) != F.col("text")).count() == 0
    assert {r["form"] for r in made.select("form").collect()} >= {"spm", "psm"}


def test_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_op12_equals_plain_loops(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_fill_in_middle(spark, sf_dir).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for key, text in docs:
        n, form, p, m, out = expected(key, text)
        assert got[key] == (n, form, None if p is None else len(p), None if m is None else len(m), sha(out), sha(text or ""))
