"""Operators of the training-data list against brute force, on the smallest tables and on awkward rows."""

import functools
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from isohyet.llm import byte_bpe, exact_dedup, language_id, line_dedup, media, near_dedup, packing, queries, sentencepiece_codec, sharding, token_store
from isohyet.llm.common import new_folder

LONG = "lorem ipsum dolor sit amet " * 4000
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog.", "x"),
    (2, "the QUICK brown fox jumps over the lazy dog.", "x"),
    (3, None, None),
    (4, "", "y"),
    (4, "", "y"),
    (None, "a row without an id", "z"),
    (5, LONG, "x"),
    (6, " \n\t  ", "y"),
    (7, "ÄÖ ß é 梦 😀 <|endoftext|> end", "z"),
    (8, "The quick brown fox jumps over the lazy dog.", "x"),
]
SCHEMA = "doc_id long, text string, `ids` string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]


@pytest.fixture(scope="module")
def piece_model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def byte_model():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def le32(ids):
    return np.array(ids, "<u4").tobytes()


def test_op1_equals_the_library(spark, sf_dir, documents, piece_model):
    got = {r["doc_id"]: r for r in queries.op1_sentencepiece(spark, sf_dir).collect()}
    assert len(got) == len(documents)
    for key, text, _ in documents:
        ids = piece_model.encode(text or "")
        assert got[key]["n_tokens"] == len(ids)
        assert got[key]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[key]["decoded_sha256"] == hashlib.sha256(piece_model.decode(ids).encode()).hexdigest()


def test_op1_awkward_rows(awkward, empty, piece_model):
    got = sentencepiece_codec.decode(sentencepiece_codec.encode(awkward)).collect()
    want = sorted((str(d), tuple(piece_model.encode(t or "")), piece_model.decode(piece_model.encode(t or ""))) for d, t, _ in AWKWARD)
    assert sorted((str(r["doc_id"]), tuple(r["ids"]), r["text"]) for r in got) == want
    assert sentencepiece_codec.encode(empty).collect() == []


@functools.cache
def loaded_byte_model():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("  \n\tabcdethion.,▁//::xX")), max_size=60))
def test_piece_codec_any_text(text):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    if "\x00" in text:
        return
    own = sentencepiece_codec.codec(public_tokenizers.path("piece_bpe_32k.model"))
    ids = model.encode(text)
    assert np.frombuffer(own.encode(text), "<i4").tolist() == ids
    assert own.decode(ids) == model.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8", max_codepoint=0x2FFF, exclude_categories=["Cn"]), st.sampled_from("  \n\t'sabcdethion.,1 ")), max_size=60))
def test_byte_bpe_any_text(text):
    model = loaded_byte_model()
    assert byte_bpe.encoder(byte_bpe.vocabulary_path()).encode(text) == le32(model.encode(text, add_special_tokens=False).ids)


def test_op2_held_out_accuracy(spark, sf_dir, documents):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op2_language(spark, sf).collect()
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]
    assert np.mean(held) >= 0.97


def test_op2_mixtures_and_awkward_rows(spark, documents, awkward, empty):
    model = language_id.fit(spark.createDataFrame(documents, "doc_id long, text string, lang string"))
    long_ = {lang: max((t for _, t, x in documents if x == lang), key=len) for lang in ("en", "de")}
    mixed = long_["en"][:3000] + " " + long_["de"][:1500]
    best, score = language_id.infer([mixed, long_["de"]], model)
    assert model.languages[best[0]] == "en" and 0.5 < score[0] < 0.85
    assert model.languages[best[1]] == "de" and score[1] > 0.95
    got = language_id.predict(awkward, model).collect()
    assert len(got) == len(AWKWARD)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 6)} == {"und"} and all(r["score"] == 0 for r in got if r["doc_id"] in (3, 4, 6))
    assert language_id.predict(empty, model).collect() == []
    odd = spark.createDataFrame([(1, "½ ²"), (2, "12 _ ٣"), (3, "12 x")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in language_id.predict(odd, model).collect()} == {1: True, 2: True, 3: False}
    nothing = language_id.fit(empty.selectExpr("doc_id", "text", "ids as lang"))
    assert {r["lang_pred"] for r in language_id.predict(awkward, nothing).collect()} == {"und"}


def brute_mixture(text, model):
    """Language and proportion by loops: a word's likelihood is the product over its trigrams, sets grow by proportion."""
    n = len(model.languages)
    raw = f"  {text.lower()} ".encode()
    fold = [b if b >= 128 or chr(b).isalpha() else 32 for b in raw]
    words = []
    for i in range(2, len(fold)):
        if fold[i] == 32:
            continue
        mixed = (fold[i - 2] * 0x9E3779B1 ^ fold[i - 1] * 0x85EBCA6B ^ fold[i] * 0xC2B2AE35) % 2**32
        if fold[i - 1] == 32:
            words.append([0.0] * n)
        words[-1] = [w + float(x) for w, x in zip(words[-1], model.weights[mixed * 0x27D4EB2F % 2**32 >> 16], strict=True)]
    likely = [[max(math.exp(x - max(w)), 1e-12) for x in w] for w in words]

    def mixture(allowed):
        share = [1 / len(allowed) if i in allowed else 0.0 for i in range(n)]
        for _ in range(language_id.ROUNDS):
            parts = [[x * s for x, s in zip(w, share, strict=True)] for w in likely]
            share = [sum(p[i] / sum(p) for p in parts) / len(parts) for i in range(n)]
        return share, sum(math.log(max(sum(x * s for x, s in zip(w, share, strict=True)), 1e-30)) for w in likely)

    whole, bound = mixture(range(n))
    order = sorted(range(n), key=lambda i: -whole[i])
    alone = [sum(w[i] - max(w) for w in words) for i in range(n)]
    price = language_id.PENALTY * math.log(len(words) + 1.0)
    best = alone.index(max(alone))
    answer, value = (best, whole[best]), alone[best]
    for k in range(2, n + 1):
        if bound - (k - 1) * price <= value:
            break
        share, like = mixture(order[:k])
        if like - (k - 1) * price > value:
            top = share.index(max(share))
            answer, value = (top, share[top]), like - (k - 1) * price
    return answer


def test_op2_equals_plain_loops(spark, documents):
    model = language_id.fit(spark.createDataFrame(documents, "doc_id long, text string, lang string"))
    texts = [t[:600] for _, t, _ in documents[:40] if any(map(str.isalpha, t or ""))]
    texts += [f"{a} {b}" for a, b in zip(texts[:20], texts[20:40], strict=False)]
    best, score = language_id.infer(texts, model)
    for text, b, s in zip(texts, best, score, strict=True):
        want, share = brute_mixture(text, model)
        assert b == want and s == pytest.approx(share, abs=2e-3)
    assert len(set(np.round(score, 6))) > 10


def test_op2_share_of_any_size():
    assert language_id.share_of(4000, 10) == language_id.share_of(4000, 0) == 1 << 62
    for n in (10**6, 10**11, 10**15):
        assert language_id.share_of(4000, n) / 2**62 * n == pytest.approx(4000)


def test_op3_small_hosts_and_repeated_pages(spark):
    rows = [(1, "two.example", "menu\nown 1"), (2, "two.example", "menu\nown 2"), (3, "one.example", "menu\nown 3"), *[(4, "rep.example", "own 4")] * 3, (5, "rep.example", "own 5"), (None, "rep.example", "own 6"), (None, "rep.example", "foot")]
    df = spark.createDataFrame(rows, "page_id long, host string, text string")
    got = sorted((r["page_id"] or 0, r["text"]) for r in line_dedup.drop_boilerplate(df).collect())
    assert got == sorted([(1, "own 1"), (2, "own 2"), (3, "menu\nown 3"), *[(4, "own 4")] * 3, (5, "own 5"), (0, "own 6"), (0, "foot")])
    # Two rows without an id are two pages, and a line on both goes.
    both = spark.createDataFrame([(None, "a", "x\ny"), (None, "a", "x\nz")], "page_id long, host string, text string")
    assert sorted(r["text"] for r in line_dedup.drop_boilerplate(both).collect()) == ["y", "z"]


def test_op3_oracle_counts_repeated_pages_alike(spark, tmp_path):
    import duckdb

    page = lambda n, *lines: (n, "http://h.example/x", "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>")
    rows = [page(1, "menu", "one"), page(1, "menu", "one"), page(1, "menu", "more"), page(2, "menu", "two"), page(3, "three")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(queries.OP3_SQL).fetchall()
    got = queries.op3_line_dedup(spark, str(tmp_path)).select("page_id", "host", "n_lines", "n_kept", "text").collect()
    assert sorted(map(tuple, got)) == sorted(want) and {t for *_, t in want} == {"one", "more", "two", "three"}


def test_op3_lines(spark):
    rows = [(i, "a.example", f"menu\n\nown {i}\nown {i}\nfoot") for i in range(6)] + [(10, "b.example", "menu\nfoot"), (11, None, "menu"), (12, "a.example", None), (13, "b.example", "")]
    df = spark.createDataFrame(rows, "page_id long, host string, text string").withColumnRenamed("host", "host")
    got = {r["page_id"]: r for r in line_dedup.drop_boilerplate(df).collect()}
    assert len(got) == len(rows)
    assert got[2]["text"] == "\nown 2\nown 2" and got[2]["n_lines"] == 5 and got[2]["n_kept"] == 3
    assert got[10]["text"] == "menu\nfoot" and got[11]["text"] == "menu"
    assert got[12]["text"] is None and got[12]["n_lines"] == 0 and got[13]["text"] == ""
    assert line_dedup.drop_boilerplate(df.limit(0)).collect() == []


def check_packing(rows, docs, byte_model, capacity=2048):
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for key, text in docs.items():
        ids = [*byte_model.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces.pop(key), key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(le32(ids[r["start"] : r["start"] + r["length"]]))
    assert not pieces
    padding = 0
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist()
        n = sum(n for _, n in parts)
        assert n <= capacity
        padding += 0 if n & (n - 1) == 0 else capacity - n
    return padding


def test_op4_packs_everything(spark, sf_dir, documents, byte_model):
    rows = queries.op4_packing(spark, sf_dir).collect()
    assert check_packing(rows, {d: t for d, t, _ in documents}, byte_model) == 0


def test_op4_awkward_rows_and_balance(spark, awkward, empty):
    got = packing.pack(awkward, capacity=64, block_tokens=100).collect()
    assert sum(r["start"] == 0 for r in got) == len(AWKWARD)
    assert packing.pack(empty).collect() == []
    lengths = np.array([100] * 40 + [1500] * 10 + [7] * 30)
    cost = Counter()
    for _, _, n, q, _ in packing.assign(lengths, 2048):
        cost[q] += n + n * n / 2048
    assert len(cost) >= 9


def test_op5_equals_grouping(spark, sf_dir, documents, awkward, empty):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = {r[0]: r for r in con.execute(queries.OP5_SQL).fetchall()}
    got = queries.op5_exact_dedup(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == want
    rows = exact_dedup.deduplicate(awkward).collect()
    assert len(rows) == len(AWKWARD)
    found = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows}
    assert found == {(1, 8, 3, False), (2, 8, 3, False), (8, 8, 3, True), (3, 4, 3, False), (4, 4, 3, True), (None, None, 1, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True)}
    assert exact_dedup.deduplicate(empty).collect() == []


def test_op5_tells_clashing_digests_apart(awkward):
    from pyspark.sql import functions as F

    one = exact_dedup.deduplicate(awkward, digest_of=lambda text: F.lit("same"))
    two = exact_dedup.deduplicate(awkward)
    key = ["doc_id", "keep_id", "group_size", "kept"]
    assert Counter(map(tuple, one.select(key).collect())) == Counter(map(tuple, two.select(key).collect()))


def brute_feature(payload):
    """The hash by loops: means over 32 x 32 cells, plain cosine sums, signs against the median."""
    lines = [payload[i : i + 576] for i in range(0, len(payload), 576)]
    cell = lambda i, n: range(min(i * n // 32, n - 1), max((i + 1) * n // 32, min(i * n // 32, n - 1) + 1))
    mean = [[sum(lines[y][x] for y in cell(i, len(lines)) for x in cell(j, 576)) / (len(cell(i, len(lines))) * len(cell(j, 576))) for j in range(32)] for i in range(32)]
    wave = [[math.cos(math.pi * u * (i + 0.5) / 32) for i in range(32)] for u in range(8)]
    part = [[sum(wave[u][i] * mean[i][j] for i in range(32)) for j in range(32)] for u in range(8)]
    low = [round(sum(part[u][j] * wave[v][j] for j in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return f"{int(''.join('1' if x > middle else '0' for x in low), 2):016x}"


def test_op6_images(spark, sf_dir, documents, awkward, empty):
    got = {r["doc_id"]: r for r in queries.op6_media(spark, sf_dir).collect()}
    for key, text, _ in documents:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert got[key]["n_bytes"] == len(raw) and got[key]["payload_bytes"] == len(payload)
        assert got[key]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[key]["tail_crc32"] == zlib.crc32(payload[-32:])
        image = media.write_png(payload)
        assert got[key]["media_bytes"] == len(image) and got[key]["media_sha256"] == hashlib.sha256(image).hexdigest()
    for key, text, _ in sorted(documents, key=lambda d: len(d[1] or ""))[::25]:
        raw = (text or "").encode()
        assert got[key]["feature"] == brute_feature(raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576)))
    assert media.load(media.store(awkward)).count() == len(AWKWARD) and media.load(media.store(empty)).collect() == []


def test_png_filters_and_damage():
    rng = np.random.default_rng(1)
    want = rng.integers(0, 256, (12, media.WIDTH), dtype=np.uint8)
    kinds = np.array([0, 1, 2, 3, 4, 4, 3, 2, 1, 0, 4, 3])
    coded, above = np.zeros_like(want), np.zeros(media.WIDTH, int)
    for i, kind in enumerate(kinds):
        line = want[i].astype(int)
        left, corner = np.append(0, line[:-1]), np.append(0, above[:-1])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        coded[i] = (line - [0 * line, left, above, (left + above) // 2, paeth][kind]) % 256
        above = line
    first = np.arange(len(kinds)) == 0
    assert (media.unfilter(kinds, coded, first) == want).all()
    # Two images in a row, of which the second starts anew; and all filters are written and undone.
    again = media.filtered(want, first)
    both, two = np.concatenate([coded, again[:, 1:]]), np.concatenate([kinds, again[:, 0]])
    assert (media.unfilter(two, both, np.isin(np.arange(24), [0, 12])) == np.concatenate([want, want])).all()
    rest = [(rng.random((20, media.WIDTH)) < 0.05) * 3, *(rng.integers(0, n, (20, media.WIDTH)) for n in (3, 3, 60, 3))]
    picture = np.concatenate([media.unfilter(np.full(20, kind), x.astype(np.uint8), np.arange(20) == 0) for kind, x in enumerate(rest)])
    used = media.filtered(picture, np.arange(len(picture)) == 0, block=7)
    assert set(used[:, 0]) == {0, 1, 2, 3, 4} and (media.unfilter(used[:, 0], used[:, 1:], np.arange(len(picture)) == 0) == picture).all()
    with pytest.raises(ValueError):
        media.unfilter(np.array([5]), coded[:1], np.array([True]))
    image = media.write_png(want.tobytes())
    assert (media.read_png(image) == want).all()
    with pytest.raises(ValueError):
        media.read_png(image[:60] + bytes([image[60] ^ 1]) + image[61:])


def brute_components(docs, percent=85):
    sets = {}
    for key, text in docs.items():
        words = near_words(text or "")
        sets[key] = frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])
    root = {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(docs)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def near_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def test_op7_equals_all_pairs(spark, sf_dir, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op7_near_dedup(spark, sf_dir).collect()}
    assert got == brute_components({d: t for d, t, _ in documents})


def test_op7_chains_short_texts_and_awkward_rows(spark, awkward, empty):
    base = [f"w{i}" for i in range(200)]
    docs = {}
    for i in range(30):  # a chain of near copies whose ends are far apart
        words = list(base)
        for j in range(i):
            words[(7 * j) % 200] = f"x{j}"
        docs[i] = " ".join(words)
    docs |= {100 + i: " ".join(base[: 40 + i]) for i in range(12)} | {200: "one two", 201: "One\ttwo", 202: "two one", 203: None, 204: "", 205: "one two three four five"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_components(docs)
    rows = near_dedup.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD) and {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] in (1, 2, 8)} == {1: 1, 2: 1, 8: 1}
    assert near_dedup.near_duplicates(empty).collect() == []


def test_op7_rows_of_one_id_are_told_apart(spark):
    some = lambda k: [f"w{k}x{i}" for i in range(100)]
    texts = {(1, 0): some(1), (2, 0): some(2), (5, 0): [*some(1)[:98], "y", "z"], (5, 1): [*some(2)[:98], "y", "z"], (None, 0): some(1), (None, 1): some(3), (None, 2): some(3), (7, 0): some(4), (7, 1): some(4)}
    df = spark.createDataFrame([(k, " ".join(t)) for (k, _), t in texts.items()], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_dedup.near_duplicates(df).collect()))
    assert got == sorted([(1, 1, True), (2, 2, True), (5, 1, False), (5, 2, False), (0, 1, False), (0, 0, True), (0, 0, False), (7, 7, True), (7, 7, False)])
    kept = near_dedup.kept_rows(df).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 2, 7]


def check_shards(rows, docs, shards):
    assert len(rows) == len(docs)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(docs)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_op8_even_shards_keep_groups(spark, sf_dir, documents, awkward, empty):
    rows = queries.op8_sharding(spark, sf_dir).collect()
    check_shards(rows, documents, 24)
    text = {d: t for d, t, _ in documents}
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)
    where = defaultdict(list)
    for r in rows:
        where[text[r["doc_id"]]].append(r["shard"])
    groups = [g for g in where.values() if len(g) > 1]
    assert np.mean([max(Counter(g).values()) / len(g) for g in groups]) >= 0.98
    check_shards(sharding.shard(awkward, 3).collect(), AWKWARD, 3)
    assert sharding.shard(empty).collect() == []


def test_op9_store(spark, sf_dir, documents, awkward, empty, byte_model):
    got = {r["doc_id"]: r for r in queries.op9_token_store(spark, sf_dir).collect()}
    start = 0
    for key, text, _ in sorted(documents):
        ids = [*byte_model.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[key]["start"], got[key]["n_tokens"], got[key]["ids_crc32"]) == (start, len(ids), zlib.crc32(le32(ids)))
        start += len(ids)
    manifest = token_store.write(awkward, new_folder(spark, "tokens"), shard_tokens=50)
    rows = token_store.read_all(spark, manifest).collect()
    assert len(rows) == len(AWKWARD) and sum(r["doc_id"] is None for r in rows) == 1
    keys = spark.createDataFrame([(1,), (7,), (77,), (None,), (-5,)], "doc_id long")
    found = {r["doc_id"]: r["ids"] for r in token_store.lookup(manifest, keys).collect()}
    assert found[1] == le32([*byte_model.encode(AWKWARD[0][1], add_special_tokens=False).ids, 2]) and found[7] is not None
    assert found[77] is None and found[None] is None and found[-5] is None
    same = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, "last")], "doc_id long, text string")
    many = token_store.write(same, new_folder(spark, "tokens"), shard_tokens=100)
    assert many.count() > 3 and sorted(r["ids"] for r in token_store.read_all(spark, many).collect()) == sorted(le32([*byte_model.encode(t, add_special_tokens=False).ids, 2]) for t in [*(f"text {i}" for i in range(300)), "last"])
    found = {r["doc_id"]: r["ids"] for r in token_store.lookup(many, keys.limit(1).unionByName(spark.createDataFrame([(2,), (3,)], "doc_id long"))).collect()}
    assert found[1] is not None and found[2] == le32([*byte_model.encode("last", add_special_tokens=False).ids, 2]) and found[3] is None
    assert token_store.read_all(spark, token_store.write(empty, new_folder(spark, "tokens"))).collect() == []


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(3).integers(0, 1 << 62, 5000).astype(np.uint64)
    index = token_store.PerfectHash.from_bytes(token_store.PerfectHash.build(keys).to_bytes())
    assert sorted(index.slots(keys).tolist()) == list(range(5000))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_oracle_sql(spark, sf_dir, name):
    from pathlib import Path

    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    ran = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in ran.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, ran.fetchall()))


def test_byte_bpe_special_tokens_and_white_space(byte_model):
    own = byte_bpe.encoder(byte_bpe.vocabulary_path())
    for text in ("a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> x  y", "a \n b", "a  b", "x \t y  ", "\n\n x", "don't  'll", "a  b", " ", "   "):
        assert own.encode(text) == le32(byte_model.encode(text, add_special_tokens=False).ids), text


def test_shards_of_either_width():
    for top in (60_000, 70_000):
        bodies = [le32([1, top, 2]), le32([2]), le32([])]
        shard = token_store.Shard(token_store.pack_shard([5, None, 9], [0, 0, 0], bodies))
        assert [shard.tokens(shard.find(np.array([d]), np.array([n]))[0]).tobytes() for d, n in ((5, 0), (0, 1 << 40), (9, 0))] == bodies
        assert shard.payload.itemsize == (2 if top < 65536 else 4) and shard.find(np.array([6]), np.array([0]))[0] == -1


def test_other_vocabularies_are_refused():
    import json

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    byte_bpe.check_spec(spec)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}):
        with pytest.raises(ValueError):
            byte_bpe.check_spec(spec | change)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        other = json.load(f)
    with pytest.raises(ValueError):
        byte_bpe.check_spec(other)


def test_hubs_meet_their_links_over_salts(spark):
    rows = sharding.named(spark.createDataFrame([(i, "same" if i % 3 else f"own {i}") for i in range(600)], "doc_id long, text string"))
    links = sharding.written(sharding.links_of_equal_texts(rows), "links")
    assert links.count() == 2 * 399 and links.agg({"dst": "max"}).first()[0] == 599
    plain, salted = ({r["row"]: r["shard"] for r in sharding.propagate(rows, links, 3, heavy=h).collect()} for h in (10_000, 100))
    assert plain == salted
