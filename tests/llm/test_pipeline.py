"""Each stage of the pipeline against brute force on its own input, and the whole run."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from isohyet.llm.common import written

from .test_rows import brute_components, check_packing
from .test_suffix_dedup import brute_words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame([(10_000_001, None, None, None, None), (10_000_002, "12 34 !?", "en", "s", 8), (10_000_003, "", "en", "s", 0), (10_000_004, "½ ²", "en", "s", 3)], docs.schema)
    docs = written(docs.unionByName(more), "test")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]

    before = rows(docs)
    docs = written(stages["language_id"](spark, docs, sf_dir), "test")
    assert docs.columns == COLUMNS
    after = rows(docs)
    assert set(after) == {k for k, r in before.items() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert all(after[k] == before[k] for k in after)

    before = after
    docs = written(stages["exact_dedup"](spark, docs, sf_dir), "test")
    after = rows(docs)
    low = {k: "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]) for k, r in before.items()}
    keep = {}
    for k, t in low.items():
        keep[t] = max(k, keep.get(t, k))
    assert docs.columns == COLUMNS and set(after) == set(keep.values())

    before = after
    docs = written(stages["near_dedup"](spark, docs, sf_dir), "test")
    after = rows(docs)
    found = brute_components({k: r["text"] for k, r in before.items()}, 80)
    assert docs.columns == COLUMNS and set(after) == {k for k, (_, c) in found.items() if k == c}

    before = after
    docs = written(stages["suffix_dedup"](spark, docs, sf_dir), "test")
    after = rows(docs)
    want = dict(zip(before, brute_words([r["text"] for r in before.values()]), strict=True))
    assert docs.columns == COLUMNS and {k: r["text"] for k, r in after.items()} == {k: t for k, t in want.items() if t}
    assert all(r["n_chars"] == len(r["text"]) for k, r in after.items() if want[k] != before[k]["text"])

    pieces = stages["packing"](spark, docs, sf_dir).selectExpr("*", "crc32(ids) as ids_crc32").collect()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert check_packing(pieces, {k: r["text"] for k, r in after.items()}, model) == 0


def test_run_gives_sequences(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).select("sequence_id", "length").toPandas()
    assert len(out) and np.all(out.groupby("sequence_id")["length"].sum() <= 2048)


def test_mixed_documents_go_and_unlabelled_ones_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words: dict[str, list[str]] = {}
    for r in docs.filter("lang is not null").collect():
        words.setdefault(r["lang"], []).extend(r["text"].split())
    mixed = " ".join(w for four in zip(*(x[:400] for x in words.values()), strict=True) for w in four)
    more = docs.unionByName(spark.createDataFrame([(10_000_001, mixed, None, None, None)], docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.by_language(spark, more, sf_dir).collect()}
    assert len(words) == 4 and 10_000_001 not in kept and kept == {r["doc_id"] for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))}
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in corpus_pipeline.by_language(spark, bare, sf_dir).collect()} == kept


def test_repeated_ids_and_clashing_columns(spark, sf_dir):
    """Rows of one id are told apart, one row of each group stays, and columns of any name are handed on."""
    long_ = [" ".join(f"word{chr(97 + (i * j) % 26)}{chr(97 + i)}{chr(97 + j % 26)}" for j in range(60)) for i in range(4)]
    rows = [(1, "a text of its own"), (1, "b text of another kind"), (2, "A text of its own"), (3, long_[0]), (3, long_[0]), (4, long_[1] + " x"), (5, long_[1]), (5, long_[2]), (None, long_[3]), (None, long_[3])]
    extra = ["_lang_pred", "_score", "lang_pred", "score", "_stays", "row", "rest", "kept", "digest", "salt", "norm", "doc_id_", "texts"]
    df = spark.createDataFrame([(i, t, "en", "s", 1, *["x"] * len(extra)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, df, sf_dir)
        assert got.columns == df.columns and {r["score"] for r in got.collect()} <= {"x"}, name
    key = lambda r: (r["doc_id"] or 0, r["text"])
    exact = sorted(map(key, corpus_pipeline.without_copies(spark, df, sf_dir).collect()))
    assert exact == sorted([(1, rows[1][1]), (2, rows[2][1]), (3, long_[0]), (4, rows[5][1]), (5, long_[1]), (5, long_[2]), (0, long_[3])])
    near = sorted(map(key, corpus_pipeline.without_near_copies(spark, df, sf_dir).collect()))
    assert near in ([(0, long_[3])] + sorted([(1, rows[0][1]), (1, rows[1][1]), (3, long_[0]), (4, rows[5][1]), (5, long_[2])]),)
    empty = df.limit(0)
    assert all(stage(spark, empty, sf_dir).collect() == [] for _, stage in corpus_pipeline.STAGES)
