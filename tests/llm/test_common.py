"""Shared helpers."""

import numpy as np
import pytest

from isohyet.llm.common import SubstringHash, clear, free_name, scratch, shared_folder, written


def test_written_tables_are_cleared(spark):
    df = written(spark.range(3).toDF("x"), "test")
    assert df.count() == 3
    assert clear(spark) >= 1 and clear(spark) == 0


def test_equal_substrings_have_equal_hashes():
    raw = np.frombuffer(b"abcabcxabc", np.uint8)
    h = SubstringHash(raw)
    three = h.sliding(3)
    assert three[0] == three[3] == three[7] == h.of(np.array([7]), np.array([10]))[0]
    assert len(set(three.tolist())) == len({bytes(raw[i : i + 3]) for i in range(8)})
    assert len(h.sliding(11)) == 0


def test_scratch_keeps_what_is_asked_for(spark):
    with scratch(spark) as keep:
        one = written(spark.range(3).toDF("x"), "test")
        two = keep(one.filter("x > 0"), "test")
        with scratch(spark) as inner:
            three = inner(two, "test")
        assert three.count() == 2
    assert two.count() == 2
    for gone in (one, three):
        with pytest.raises(Exception, match="NOT_EXIST|does not exist|FAILED_READ"):
            gone.count()


def test_free_names():
    assert free_name("Score", ["score", "_score"]) == "__Score" and free_name("x", []) == "x"


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}
        sparkContext = Cluster()

    with pytest.raises(ValueError):
        shared_folder(Session())


def test_words_of_thue_and_morse_keep_apart():
    """Words whose letters are swapped everywhere, which polynomials modulo a power of two can't tell apart."""
    for k in range(8, 17):
        n = 1 << k
        sign = np.array([bin(i).count("1") & 1 for i in range(n)])
        for a, b, kind in ((97, 98, np.uint8), (0x123456789ABCDEF1, 0xFEDCBA9876543217, np.uint64)):
            raw = np.concatenate([np.array([a, b], kind)[sign], np.array([b, a], kind)[sign]])
            one, two = SubstringHash(raw).of(np.array([0, n]), np.array([n, 2 * n]))
            assert one != two


def test_hashes_equal_plain_arithmetic():
    raw = np.random.default_rng(1).integers(0, 3, 2000).astype(np.uint8)
    h = SubstringHash(raw)
    for width in (1, 4, 9, 300):
        seen = {}
        for i, x in enumerate(h.sliding(width).tolist()):
            assert seen.setdefault(raw[i : i + width].tobytes(), x) == x
        assert len(set(seen.values())) == len(seen)
        start = np.arange(2001 - width)
        assert np.array_equal(h.of(start, start + width), h.sliding(width))
