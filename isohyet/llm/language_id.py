"""Multilingual mixture inference of languages.

A model holds, for every language, the log-probability of hashed byte trigrams. A document is a mixture: each word
comes from one language, and expectation-maximisation estimates the proportions from the words' n-gram likelihoods.
Languages are taken into a document's set in the order of their proportions as long as the likelihood, penalised for
each further language, grows. The language of the largest proportion in that set is the answer.

The score is the proportion of that language: over all languages if it alone is taken, else over the set.

The model is fitted on a bounded sample: of each language `per_language` of the given labelled rows are expected, chosen
by a hash of their id; of fewer rows all are taken. Its size depends on the number of hash cells and languages only.

Rows: a null or empty text, or one without a letter, is `und` with score 0. Equal likelihoods go to the language that
sorts first. Rows stand alone, so repeated rows get equal answers; without labelled rows every answer is `und`; an
empty table has no answers. Extra columns are left out. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isohyet.llm.common import HASHED_BYTES, batch_size, narrow, slices, tidy

CELLS = 1 << 16
PER_LANGUAGE = 4000
ROUNDS = 8
PENALTY = 2.0  # of a language, times the logarithm of the number of words
UNKNOWN = "und"
#: Bytes below 128 that aren't letters part words; others stand as they are.
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def share_of(per_language: int, rows: int) -> int:
    """Of 2**62 hash values, those that are taken from a language with so many rows."""
    return min(1 << 62, (per_language << 62) // max(1, rows))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # CELLS x languages, float32 log-probabilities


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts put one behind another: trigram cells, the first trigram of each word, and the number of
    words up to the end of each text. Trigrams belong to the word that their last letter is in; a text without a word
    has one word of a space."""
    raw = "".join(f"  {t.lower()} " for t in texts).encode()
    b = _FOLD[np.frombuffer(raw, np.uint8)]
    cell = ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F) >> np.uint32(16)
    keep = b[2:] != 32
    first = keep & (b[1:-1] == 32)
    lengths = np.array([len(t.lower().encode()) + 3 for t in texts])
    ends = np.cumsum(lengths) - 3  # of the last byte, as the third of a trigram
    words = np.cumsum(first)[ends + 0] if len(b) > 2 else np.zeros(len(texts), int)
    starts = np.flatnonzero(first[keep])
    return cell[keep], starts, words


def fit(df: DataFrame, label_col: str = "lang", per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from the labelled rows of df; rows with a null label or text are passed over."""
    rows = df.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("text").isNotNull())
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((CELLS, 0), np.float32))
    share: Column = F.lit(0).cast("long")
    for name, n in sizes.items():
        share = F.when(F.col("label") == name, F.lit(share_of(per_language, n))).otherwise(share)
    sample = rows.filter(F.shiftrightunsigned(F.xxhash64("key"), 2) < share).select("label", "text")

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for b in slices(batches):
            label = np.array(b["label"].to_pylist(), object)
            texts = b["text"].to_pylist()
            for name in set(label):
                cells, _, _ = grams([t for t, x in zip(texts, label, strict=True) if x == name])
                found[name] = found.get(name, 0) + np.bincount(cells, minlength=CELLS)
        for name, n in found.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(n[used], pa.int64())], ["label", "cell", "n"])

    counts = np.full((CELLS, len(languages)), 0.5)
    place = {name: i for i, name in enumerate(languages)}
    for r in sample.mapInArrow(count, "label string, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"], place[r["label"]]] += r["n"]
    return Model(languages, np.log(counts / counts.sum(0)).astype(np.float32))


def _proportions(likely: np.ndarray, doc: np.ndarray, starts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for many documents at once: proportions over the allowed languages, log-likelihood."""
    n = np.diff(np.append(starts, len(doc)))[:, None]
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        part = likely * share[doc]
        part /= part.sum(1, keepdims=True)
        share = np.add.reduceat(part, starts, axis=0) / n
    mixed = np.log(np.maximum((likely * share[doc]).sum(1), 1e-30))
    return share, np.add.reduceat(mixed, starts)


def infer(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Language index and proportion of each text; every text must have a letter."""
    cells, first, words = grams(texts)
    spread = np.add.reduceat(model.weights[cells], first, axis=0)
    top = spread.max(1, keepdims=True)
    likely = np.maximum(np.exp(spread - top), 1e-12)
    sizes = np.diff(words, prepend=0)
    doc, starts = np.repeat(np.arange(len(texts)), sizes), words - sizes
    single = np.add.reduceat(spread - top, starts, axis=0)
    best = single.argmax(1)
    value = single.max(1)
    price = PENALTY * np.log(sizes + 1.0)
    share, bound = _proportions(likely, doc, starts, np.ones((len(texts), len(model.languages)), np.float32))
    score = share[np.arange(len(texts)), best]
    order = np.argsort(-share, axis=1, kind="stable")
    open_ = np.flatnonzero(bound - price > value)  # no set can do better than all languages do
    for k in range(2, len(model.languages) + 1):
        if not len(open_):
            break
        held = np.isin(doc, open_)
        allowed = np.zeros((len(open_), len(model.languages)), np.float32)
        np.put_along_axis(allowed, order[open_, :k], 1.0, axis=1)
        own_sizes = sizes[open_]
        got, like = _proportions(likely[held], np.repeat(np.arange(len(open_)), own_sizes), np.cumsum(own_sizes) - own_sizes, allowed)
        like = like - (k - 1) * price[open_]
        better = like > value[open_]
        chosen = open_[better]
        best[chosen], score[chosen], value[chosen] = got[better].argmax(1), got[better].max(1), like[better]
        open_ = open_[bound[open_] - k * price[open_] > value[open_]]
    return best, np.clip(score, 0.0, 1.0)


def with_language(df: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """df with all its columns, and the language and score of every whole text of a string column."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # CELLS x languages floats, whatever the input
    place = df.columns.index(text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches, HASHED_BYTES):
            texts = [t or "" for t in b.column(place).to_pylist()]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if own.languages and has_letter(t)]
            if known:
                best, score = infer([texts[i] for i in known], own)
                scores[known] = score
                for i, x in zip(known, best, strict=True):
                    names[i] = own.languages[x]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, lang_out, score_out])

    batch_size(df.sparkSession)
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    return with_language(narrow(df, id_col, text_col), model).select("doc_id", "lang_pred", "score")
