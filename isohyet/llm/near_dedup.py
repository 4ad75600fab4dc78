"""MinHash near-deduplication with bottom-k sketches.

One hash function orders all shingles; a document's sketch is its k smallest values. Two documents that are alike
share most of the k smallest values of their union, so at least `shared` of them are in both sketches: among any
k - shared + 1 retained values of a document at least one is shared. The inverted lists are therefore made from each
document's rarest retained values only, which keeps passages that many documents share out of the lists unless a
document consists mostly of them. Candidates come from the lists in steps, so that no long list is expanded into all
its pairs: first every member meets the list's leaders of about its size, the documents with the most common values;
then members of different components meet in short lists. For the members of long lists exact lists are made, from the
rarest (1 - similarity) of each document's whole set: a document with more shingles of its own than that meets nobody,
and copies of a common origin have been joined by their leaders, so these lists hold what is left. Union-sketch
estimates filter the candidates and exact Jaccard similarity on full shingle sets decides.

The least number of shared values and the least estimate follow from the similarity and k (`bounds`): a pair that is
similar enough shares too few values with a probability under 1e-8, and its estimate is too low with one under 2e-7;
sets of up to k shingles are handled exactly.

Rows: words are runs of characters other than ASCII white space, A-Z lower-cased. A document with fewer than five
words has its word sequence as its one shingle; a null or empty text has none and is linked with nothing. Equal sets
are one class with one representative. Where doc_ids repeat or are null, every row gets a number of its own, so rows
are told apart by themselves: each has its own links, component_id is the smallest doc_id of the component (null if it
has none), and one row of a component is kept - that with the smallest doc_id, then the smallest hash of its text, then
number. An empty table gives an empty table. `near_duplicates` leaves extra columns out, `kept_rows` hands them on,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import HASHED_BYTES, SubstringHash, batch_size, narrow, scratch, slices, tidy, written
from isohyet.llm.components import connected

WORDS, PERCENT, K = 5, 80, 64
FEW_SHARED, LOW_ESTIMATE = 1e-8, 2e-7  # probabilities that a pair of just the similarity is missed
SHORT_LIST = 32  # documents of a list that meet each other directly
MOST_BROADCAST = 250_000  # ids that are sent to all tasks at most; beyond that, a shuffle does it
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def bounds(percent: int, k: int = K) -> tuple[int, int]:
    """The least number of the k smallest values of a union that a pair shares, for the lists and for the estimate."""
    p, below, found = percent / 100, 0.0, [0, 0]
    for n in range(k):
        below += math.comb(k, n) * p**n * (1 - p) ** (k - n)
        found = [n + 1 if below <= most else least for most, least in zip((FEW_SHARED, LOW_ESTIMATE), found, strict=True)]
    return max(1, found[0]), max(1, found[1])


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles."""
    raw = _LOWER[np.frombuffer("".join(f"{t}\n" for t in texts).encode(), np.uint8)]
    space = _SPACE[raw]
    begins = np.flatnonzero(~space & np.append(True, space[:-1]))
    after = np.flatnonzero(space & np.append(False, ~space[:-1]))  # the white space right after a word
    keep = ~space
    keep[after] = True
    raw[after] = 32
    place = np.cumsum(keep) - 1
    clean = SubstringHash(raw[keep])
    begin, end = place[begins], place[after]
    lengths = np.cumsum([len(t.encode()) + 1 for t in texts])
    upto = np.searchsorted(begins, lengths)  # words up to the end of each text
    out, first = [], 0
    for last in upto.tolist():
        n = last - first
        if n == 0:
            out.append(np.zeros(0, np.uint64))
        elif n < words:
            out.append(clean.of(begin[first : first + 1], end[last - 1 : last]))
        else:
            out.append(np.unique(clean.of(begin[first : last - words + 1], end[first + words - 1 : last])))
        first = last
    return out


def features(df: DataFrame, words: int = WORDS, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, set_key BINARY, sketch BINARY): set size, a digest of the whole set, the k smallest values."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, HASHED_BYTES):
            sets = shingle_sets([t or "" for t in b["text"].to_pylist()], words)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([s[:k].tobytes() for s in sets], pa.binary())], ["doc_id", "n", "set_key", "sketch"]
            )

    batch_size(df.sparkSession)
    return narrow(df, id_col, text_col).mapInArrow(run, "doc_id long, n long, set_key binary, sketch binary")


def postings(reps: DataFrame) -> DataFrame:
    """(value, doc_id, n) of every retained value."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, HASHED_BYTES):
            sketches = [np.frombuffer(x, np.int64) for x in b["sketch"].to_pylist()]
            if not sketches:
                continue
            sizes = [len(s) for s in sketches]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(sketches)), pa.array(np.repeat(b["doc_id"].to_numpy(zero_copy_only=False), sizes)), pa.array(np.repeat(b["n"].to_numpy(zero_copy_only=False), sizes))], ["value", "doc_id", "n"]
            )

    return reps.select("doc_id", "n", "sketch").mapInArrow(run, "value long, doc_id long, n long")


def rarest(posted: DataFrame, held: Column, must: Column) -> DataFrame:
    """(value, df, doc_id, n, common, pos): the lists of at least two documents, from each document's rarest values.

    posted has (value, doc_id, n). Of `held` values at least `must` are shared by a pair, so held - must + 1 are looked
    up. `common` is the mean logarithm of the document frequencies: high for what others are copies of. `pos` is the
    value's place among the document's values, rarest first."""
    # Tables that a hot value meets are written first: Spark can split a join of what it only reads.
    often = written(posted.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "often")
    per_doc = posted.join(often, "value").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("seen"), F.sum(F.log("df")).alias("common"))
    take = held - must + 1 - (held - F.size("seen"))
    alone = held - F.size("seen")  # values of no other document come first
    chosen = per_doc.filter(take > 0).select("doc_id", "n", (F.col("common") / held).alias("common"), alone.alias("alone"), F.posexplode(F.slice("seen", F.lit(1), take.cast("int"))).alias("i", "x"))
    return chosen.select(F.col("x.value").alias("value"), F.col("x.df").alias("df"), "doc_id", "n", "common", (F.col("alone") + F.col("i")).alias("pos"))


def inverted_lists(reps: DataFrame, k: int = K, shared: int | None = None, percent: int = PERCENT) -> DataFrame:
    """Lists of retained values. Up to the size that no larger partner can have, a sketch holds the whole set."""
    whole = F.col("n") * 100 < F.lit(k * percent)
    return rarest(postings(reps), F.least("n", F.lit(k)), F.when(whole, _overlap(percent)).otherwise(F.lit(shared or bounds(percent, k)[0])))


def _overlap(percent: int) -> Column:
    """The shingles of a set that any partner has at least."""
    return F.floor((F.col("n") * percent + 99) / 100)


def exact_lists(docs: DataFrame, ids: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Lists of all shingles of some documents."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, HASHED_BYTES):
            sets = shingle_sets([t or "" for t in b["text"].to_pylist()], words)
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(b["doc_id"].to_numpy(zero_copy_only=False), sizes)), pa.array(np.repeat(sizes, sizes))], ["value", "doc_id", "n"])

    batch_size(docs.sparkSession)
    posted = _of(docs, ids).mapInArrow(run, "value long, doc_id long, n long").distinct()
    return rarest(posted, F.col("n"), _overlap(percent))


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with the given ids; few ids are sent to all tasks, many are shuffled."""
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "doc_id", "left_semi")


def _alike(a: str, b: str, percent: int):
    """Whether the sizes allow the similarity."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def leader_pairs(lists: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) between members and the leaders - those most in common - of their list's size classes near theirs."""
    ratio = float(np.log(100.0 / percent))
    classed = lists.withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) / ratio).cast("int"))
    heads = classed.groupBy("value", "size_class").agg(F.max(F.struct("common", (-F.col("doc_id")).alias("minus"), "n")).alias("head"))
    heads = written(heads.select("value", F.explode(F.array(*(F.col("size_class") + d for d in (-1, 0, 1)))).alias("size_class"), (-F.col("head.minus")).alias("lead"), F.col("head.n").alias("lead_n")), "heads")
    met = classed.join(heads, ["value", "size_class"]).filter((F.col("doc_id") != F.col("lead")) & _alike("n", "lead_n", percent))
    return met.select(F.least("doc_id", "lead").alias("a"), F.greatest("doc_id", "lead").alias("b")).distinct()


def open_lists(lists: DataFrame, components: DataFrame) -> DataFrame:
    """Lists with their members' components, as far as members of several components meet there."""
    named = lists.join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = written(named.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("value"), "several")
    return written(named.join(several, "value", "left_semi"), "open")


def cross_pairs(opened: DataFrame, percent: int = PERCENT, whole: bool = False) -> DataFrame:
    """(a, b) between members of one list that are not in one component yet.

    In lists of whole sets the smaller set of a pair needs only the values that it can lack and still reach the overlap
    of two equal sizes, and the places of a shared value bound the overlap."""
    other = opened.select("value", F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"), F.col("pos").alias("at"))
    wanted = (F.col("component") != F.col("other")) & _alike("n", "m", percent)
    if whole:
        opened = opened.filter(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * 2 * percent / (100.0 + percent)))
        bound = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"))  # of the overlap, at the rarest shared value
        wanted &= ((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("doc_id") < F.col("b")))) & (bound * (100 + percent) >= percent * (F.col("n") + F.col("m")))
    else:
        wanted &= F.col("doc_id") < F.col("b")
    met = opened.join(other, "value").filter(wanted)
    return met.select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")).distinct()


def union_estimate(x: bytes, y: bytes, k: int = K) -> float:
    """Share of the k smallest values of the union that are in both sketches."""
    both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
    same = both[1:] == both[:-1]
    first = np.append(True, ~same)
    rank = np.cumsum(first)
    within = min(k, int(rank[-1]))
    return float((same & (rank[1:] <= within)).sum()) / within


def likely(pairs: DataFrame, reps: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """The pairs whose union-sketch estimate is high enough."""
    sketches = reps.select("doc_id", "sketch")
    least = bounds(percent, k)[1] / k
    both = pairs.join(sketches.withColumnsRenamed({"doc_id": "a", "sketch": "x"}), "a").join(sketches.withColumnsRenamed({"doc_id": "b", "sketch": "y"}), "b")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [union_estimate(x, y, k) >= least for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; pairs must be a written table, docs (doc_id, text) with
    unique ids."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()

    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, HASHED_BYTES):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([s.tobytes() for s in shingle_sets([t or "" for t in b["text"].to_pylist()], words)], pa.binary())], ["doc_id", "shingles"])

    @tidy
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    batch_size(docs.sparkSession)
    full = _of(docs, ids).mapInArrow(sets, "doc_id long, shingles binary")
    full = written(full, "sets")
    both = pairs.join(full.withColumnsRenamed({"doc_id": "a", "shingles": "x"}), "a").join(full.withColumnsRenamed({"doc_id": "b", "shingles": "y"}), "b")
    return both.mapInArrow(test, "a long, b long")


def _linked(docs: DataFrame, known: DataFrame, words: int, percent: int, k: int, shared: int | None, short_list: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents with unique ids and their written features."""
    with scratch(docs.sparkSession) as keep:
        named = known.filter("n > 0")
        classes = keep(named.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
        reps = written(named.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "reps")
        lists = written(inverted_lists(reps, k, shared, percent), "lists")

        def links(pairs: DataFrame) -> DataFrame:
            with scratch(docs.sparkSession) as keep_links:
                return keep_links(confirmed(written(likely(pairs, reps, k, percent), "pairs"), docs, words, percent), "links")

        first = links(leader_pairs(lists, percent))
        grouped = connected(first)
        opened = open_lists(lists, grouped)
        short = links(cross_pairs(opened.filter(F.col("df") <= short_list), percent))
        crowded = opened.filter(F.col("df") > short_list).select("doc_id").distinct()
        exact = written(exact_lists(docs, crowded, words, percent), "lists")
        led = links(leader_pairs(exact, percent))
        found = first.unionByName(short).unionByName(led)
        rest = links(cross_pairs(open_lists(exact, connected(found)), percent, whole=True))
        linked = keep(connected(found.unionByName(rest)), "linked")
    member = known.join(classes, "set_key", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    return member.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def _answered(df: DataFrame, words: int, percent: int, k: int, shared: int | None, short_list: int, id_col: str, text_col: str, carry: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """(doc_id, n_shingles, component_id, kept, row) for every row; and, where ids don't name rows, the numbered rows."""
    docs = narrow(df, id_col, text_col)
    known = written(features(docs, words, k), "features")
    n = known.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if n["rows"] == n["ids"]:
        found = _linked(docs, known, words, percent, k, shared, short_list)
        return None, found.withColumns({"kept": F.col("doc_id") == F.col("component_id"), "row": F.col("doc_id")})
    rest = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("rest")] if carry else []
    text = F.col(text_col).cast("string")
    rows = written(df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"), *rest), "rows")
    numbered = rows.select(F.col("row").alias("doc_id"), "text")
    found = _linked(numbered, written(features(numbered, words, k), "features"), words, percent, k, shared, short_list)
    named = rows.select("row", "doc_id", "mark").join(found.withColumnRenamed("doc_id", "row"), "row")
    first = written(named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark", "row")).alias("first")), "first")
    answers = named.join(first, "component_id").select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"), "row")
    return rows, answers


def near_duplicates(df: DataFrame, words: int = WORDS, percent: int = PERCENT, k: int = K, shared: int | None = None, short_list: int = SHORT_LIST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of df."""
    return _answered(df, words, percent, k, shared, short_list, id_col, text_col, [])[1].drop("row")


def kept_rows(df: DataFrame, words: int = WORDS, percent: int = PERCENT, k: int = K, shared: int | None = None, short_list: int = SHORT_LIST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, of which one a component stays."""
    rows, answers = _answered(df, words, percent, k, shared, short_list, id_col, text_col, df.columns)
    stays = answers.filter("kept").select("row")
    if rows is None:
        return df.join(stays, df[id_col].cast("long") == stays["row"], "left_semi")
    return rows.join(stays, "row", "left_semi").select(*(F.col(f"rest.`{c}`").alias(c) for c in df.columns))
