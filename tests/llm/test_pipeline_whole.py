"""The pipeline's stages at the thresholds that they are to reach."""

import random

import corpus_pipeline
from isohyet.llm import near_dedup
from isohyet.llm.common import written

from .test_rows import brute_components
from .test_suffix_dedup import brute_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return written(spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], SCHEMA), "test")


def test_near_copies_from_80_percent(spark, sf_dir):
    rng, texts = random.Random(4), {}
    for i in range(60):  # long pairs with 13 to 27 % of the union not shared
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        cut = 30 + i // 2
        texts[2 * i] = " ".join(words)
        texts[2 * i + 1] = " ".join(words[cut:] + [f"x{rng.randrange(10**6)}" for _ in range(cut)])
    at80, at85 = ({k for k, (_, c) in brute_components(texts, p).items() if k == c} for p in (80, 85))
    assert len(at85 - at80) > 5 and len(at80) > 70
    got = {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, frame(spark, texts), sf_dir).collect()}
    assert got == at80
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(real, percent=80).collect()}
    assert got == {k: c for k, (_, c) in brute_components({r["doc_id"]: r["text"] for r in real.collect()}, 80).items()}


def test_near_bounds_follow_the_similarity():
    assert near_dedup.bounds(85) == (36, 38) and near_dedup.bounds(80) == (31, 33)


def test_repeats_of_51_words(spark, sf_dir):
    rng = random.Random(9)
    some = lambda n, size=5: " ".join("".join(rng.choice("abcdefghé") for _ in range(size)) for _ in range(n))
    p51, p50, long, short = some(51), some(50), some(60, 12), some(51, 2)
    texts = {i: f"{some(30)} {p51}\n{some(20)}  {p50} {some(9)}" for i in range(4)}
    texts |= {4: f" {short}", 5: f"{some(3)} {short.replace(' ', chr(10))} {some(4)}", 6: long, 7: f"{some(70)} {long}", 8: "z" * 900, 9: some(60)}
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_repeats(spark, frame(spark, texts), sf_dir).collect()}
    want = dict(zip(texts, brute_words(list(texts.values())), strict=True))
    assert got == {k: t for k, t in want.items() if t}
    assert not any(p51 in t for t in got.values()) and sum(p50 in t for t in got.values()) == 4 and 4 not in got
    real = written(spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text <> ''"), "test")
    before = {r["doc_id"]: r["text"] for r in real.collect()}
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_repeats(spark, real, sf_dir).collect()}
    assert got == {k: t for k, t in zip(before, brute_words(list(before.values())), strict=True) if t}
