"""Very long runs of one character, and structured words that hashes must keep apart."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from isohyet.llm import byte_bpe, near_dedup, packing, suffix_dedup


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") & 1 else a for i in range(n))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("n", [10, 4_999, 9_999, 10_000, 10_001, 1_000_000])
@pytest.mark.parametrize("c", [" ", "\n", " \n", "a"])
def test_runs_have_the_librarys_ids(library, n, c):
    text = f"x <|endoftext|>{c * (n // len(c))}y  z"
    assert np.frombuffer(byte_bpe.encoder(byte_bpe.vocabulary_path()).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_run_is_packed(spark, library):
    text = "x" + " " * 1_000_000 + "y"
    pieces = packing.pack(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")).collect()
    ids = b"".join(r["ids"] for r in sorted(pieces, key=lambda r: r["start"]) if r["doc_id"] == 1)
    assert np.frombuffer(ids, "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


def test_words_of_thue_and_morse_are_no_near_duplicates(spark):
    docs = [(k, thue_morse(1 << k)) for k in (8, 10, 12)] + [(100 + k, thue_morse(1 << k, "b", "a")) for k in (8, 10, 12)]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: d for d, _ in docs}


@pytest.mark.parametrize("width", [400, 1024])
def test_words_of_thue_and_morse_are_no_repeats(spark, width):
    """Two texts that differ in every letter; a window repeats only where it does by plain search."""
    one, two = thue_morse(1024), thue_morse(1024, "y", "x")
    docs = [(1, one), (2, thue_morse(1024, "b", "a")), (3, two)]
    windows = {}
    for d, t in docs:
        for i in range(len(t) - width + 1):
            windows.setdefault(t[i : i + width], []).append((d, i))
    gone = {d: set() for d, _ in docs}
    for places in windows.values():
        if len(places) > 1:
            for d, i in places:
                gone[d] |= set(range(i, i + width))
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), width=width).collect()}
    assert got == {d: len(g) for d, g in gone.items()} and got[3] == 0
