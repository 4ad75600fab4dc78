"""Toxicity by noisy-channel deobfuscation.

A character language model holds interpolated four-gram counts of all texts that it is fitted on. Where a text shows signs
of disguise - digits and signs among letters, letters three times in a row, letters set apart one by one - the stretch
becomes a lattice of what each character may stand for, and a Viterbi search finds the likeliest reading under language
model and channel. Elsewhere a text has one reading, itself. The restored text is scored by a logistic regression over
word beginnings and short whole words, and how often a document has them.

The language model counts every text and byte. The regression is fitted on a bounded sample: `per_label` distinct texts
of each label are expected, chosen by a hash of the text; of fewer all are taken, of equal texts one. Beginnings of words are kept as they
are, not hashed, if a likelihood ratio test finds them tied to the label.

Rows: a null or empty text is empty, and has the score of a text without any sign. Rows stand alone, so repeated rows
get equal scores. Rows without a label, or with a null text, are not learned from;
with fewer than two labels every score is 0. An empty table has no scores. Extra columns are left out. Texts of any
length are read whole; a stretch of more than BLOCK units is read in blocks, each from the best reading of those before.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import batch_size, byte_view, narrow, slices, written

PER_LABEL = 4000
SYMBOLS = 32
ORDER = 4
CELLS = SYMBOLS**ORDER
BLOCK = 4096
BLOCK_BYTES = 1 << 22  # of a text that are looked at together; a bound on memory only
MEMO = 100_000  # stretches that a worker remembers; a bound on memory only
#: Signs and the letters they stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
STRONG, BETWEEN = "0134578@$", "!|+"  # signs that count beside a letter, and between letters only
SEPARATORS = " .-_*"
#: Log-probabilities of the channel: a sign for a letter, a sign for itself among letters, a letter once or twice of
#: several, once of two, a separator put in, a separator of its own.
SIGN, ITSELF, REPEATED, DOUBLED, PUT_IN, APART = -1.0, -6.0, -1.0, -3.0, -0.7, -2.0


def _symbols() -> np.ndarray:
    """Bytes as symbols: 0 for what is no letter, 1 to 26, five more for the bytes of other letters."""
    return np.array([27 + b % 5 if b >= 128 else ord(chr(b).lower()) - 96 if chr(b).isalpha() else 0 for b in range(256)], np.int32)


_SYMBOL = _symbols()
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _table(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in chars])


_LETTER = (np.arange(256) >= 128) | np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_STRONG, _BETWEEN, _SEPARATOR = _table(STRONG), _table(BETWEEN), _table(SEPARATORS)


# --- Language model ---


@dataclass
class CharModel:
    """Log-probabilities of a symbol after three others, by the number of the four."""

    logs: np.ndarray  # CELLS, float32

    @functools.cached_property
    def values(self) -> array:
        return array("f", self.logs.tobytes())


def _blocks(safe: Callable[[np.ndarray], np.ndarray], data: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Blocks of about so many bytes, each ending behind a byte at which it is safe to cut; where there is none, further on."""
    first, last = 0, 0
    while last < len(data):
        last = min(last + size, len(data))
        places = np.flatnonzero(safe(data[first:last])) if last < len(data) else np.zeros(0, int)
        if last < len(data) and not len(places):
            continue
        last = first + int(places[-1]) + 1 if len(places) else last
        yield first, last
        first = last


def grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of the four-grams of many texts, each with three blanks before it and one behind."""
    sizes = np.diff(offsets)
    ends = np.cumsum(sizes + ORDER)
    s = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = 0
    for first, end, size in zip(offsets.tolist(), ends.tolist(), sizes.tolist(), strict=False):
        s[at + ORDER - 1 : end - 1] = _SYMBOL[raw[first : first + size]]
        at = end
    whole = np.ones(max(0, len(s) - ORDER + 1), bool)
    for k in range(1, ORDER):  # those that reach from one text into the next
        whole[ends[:-1] - k] = False
    counts = np.zeros(CELLS, np.int64)
    for a in range(0, len(whole), BLOCK_BYTES):
        part = s[a : a + BLOCK_BYTES + ORDER - 1].astype(np.int32)
        n = ((part[:-3] * SYMBOLS + part[1:-2]) * SYMBOLS + part[2:-1]) * SYMBOLS + part[3:]
        counts += np.bincount(n[whole[a : a + BLOCK_BYTES]], minlength=CELLS)
    return counts


def model_of(counts: np.ndarray) -> CharModel:
    """Each order is interpolated with the next lower one, weighted by how many different symbols follow a context."""
    lower = np.full((1, SYMBOLS), 1.0 / SYMBOLS)
    for order in range(1, ORDER + 1):
        n = counts.reshape(SYMBOLS ** (ORDER - order), SYMBOLS ** (order - 1), SYMBOLS).sum(0).astype(float)
        kinds = (n > 0).sum(1, keepdims=True) + 1.0
        lower = (n + kinds * np.tile(lower, (len(n) // len(lower), 1))) / (n.sum(1, keepdims=True) + kinds)
    return CharModel(np.log(lower).ravel().astype(np.float32))


def fit_characters(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> CharModel:
    """The counts of all texts; each task sends on the cells that it has seen, at most CELLS, whatever it reads."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(CELLS, np.int64)
        for b in slices(batches):
            held += grams(*byte_view(b["text"]))
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(held[used])], ["cell", "n"])

    batch_size(df.sparkSession)
    found = narrow(df, id_col, text_col).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(CELLS, np.int64)
    table = found.toArrow()  # CELLS rows at most
    counts[table["cell"].to_numpy()] = table["n"].to_numpy()
    return model_of(counts)


# --- Lattices ---


def lattice(stretch: bytes) -> list[list[tuple[bytes, float]]]:
    """Units of a lower-cased stretch, each with its readings and their log-probabilities under the channel."""
    units: list[list[tuple[bytes, float]]] = []
    at, text = 0, stretch.decode("utf-8", "surrogateescape")
    while at < len(text):
        c = text[at]
        end = at
        while end < len(text) and text[end] == c:
            end += 1
        raw, times = c.encode("utf-8", "surrogateescape"), end - at
        if c in SEPARATORS:
            units += [[(b"", PUT_IN), (raw, APART)]] * times
        elif c in LEET:
            read = [(x.encode(), SIGN) for x in LEET[c]]
            if times > 2:
                units.append([*read, *((2 * x, SIGN) for x, _ in read), (raw * times, ITSELF)])
            else:
                units += [[*read, (raw, ITSELF)]] * times
        elif times > 1 and c.isalpha():
            units.append([(2 * raw, 0.0), (raw, DOUBLED)] if times == 2 else [(raw, REPEATED), (2 * raw, REPEATED)])
        else:
            units.append([(raw * times, 0.0)])
        at = end
    return units


def decode(stretch: bytes, model: CharModel) -> bytes:
    """The likeliest reading of a stretch between two blanks; of equal ones that which a unit lists first."""
    logs, symbol = model.values, _SYMBOL.tolist()
    best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # context -> score, and its readings as a linked list
    done: list[bytes] = []

    def readings(chain: tuple) -> list[bytes]:
        out = []
        while chain:
            out.append(chain[1])
            chain = chain[0]
        return out[::-1]

    for i, unit in enumerate(lattice(stretch)):
        if i and i % BLOCK == 0:
            context, (_, chain) = max(best.items(), key=lambda x: x[1][0])
            done += readings(chain)
            best = {context: (0.0, ())}
        grown: dict[int, tuple[float, tuple]] = {}
        for context, (score, chain) in best.items():
            for out, price in unit:
                s, c = score + price, context
                for b in out:
                    x = c * SYMBOLS + symbol[b]
                    s += logs[x]
                    c = x % (CELLS // SYMBOLS)
                if c not in grown or s > grown[c][0]:
                    grown[c] = (s, (chain, out))
        best = grown
    _, chain = max(best.items(), key=lambda x: x[1][0] + logs[x[0] * SYMBOLS])[1]
    return b"".join([*done, *readings(chain)])


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _holding(mask: np.ndarray, signs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a mask that hold so many signs."""
    starts, ends = _runs(mask)
    total = np.concatenate([[0], np.cumsum(signs)])
    kept = total[ends] - total[starts] >= least
    return starts[kept], ends[kept]


def _no_stretch(low: np.ndarray) -> np.ndarray:
    """Bytes that are in no stretch: neither letter nor sign nor separator, or separators behind two letters."""
    letter = _LETTER[low]
    out = ~(letter | _STRONG[low] | _BETWEEN[low] | _SEPARATOR[low])
    out[2:] |= _SEPARATOR[low[2:]] & letter[1:-1] & letter[:-2]
    return out


def stretches(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lower-cased bytes show signs of disguise: first and last places, in order, not overlapping."""
    found = [np.stack(_stretches(low[a:b])) + a for a, b in _blocks(_no_stretch, low)]
    return tuple(np.concatenate(found, 1)) if found else (np.zeros(0, int), np.zeros(0, int))


def _stretches(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(low) < 3:
        return np.zeros(0, int), np.zeros(0, int)
    letter, strong, between = _LETTER[low], _STRONG[low], _BETWEEN[low]
    sign = strong | between
    before = lambda m, k=1: np.concatenate([np.zeros(k, bool), m[:-k]])
    after = lambda m, k=1: np.concatenate([m[k:], np.zeros(k, bool)])
    odd = strong & (before(letter) | after(letter)) | between & before(letter | sign) & after(letter | strong)
    same = lambda k: np.concatenate([np.zeros(k, bool), low[k:] == low[:-k]])
    one = letter & same(1)
    odd |= one & before(one) & (low < 128)
    two = same(2) & (low >= 128)
    odd |= two & before(two) & before(two, 2) & before(two, 3)
    word = letter | strong | between & (before(letter | sign) & after(letter | sign))
    starts, ends = _holding(word, odd, 1)
    single = (letter & (low < 128) | strong) & ~before(word) & ~after(word)
    separator = _SEPARATOR[low] & before(single) & after(single)
    apart_starts, apart_ends = _holding(single | separator, single & letter, 3)
    spaced = apart_ends - apart_starts >= 5
    starts, ends = np.concatenate([starts, apart_starts[spaced]]), np.concatenate([ends, apart_ends[spaced]])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    free = np.concatenate([[True], starts[1:] >= np.maximum.accumulate(ends)[:-1]]) if len(starts) else np.zeros(0, bool)
    return starts[free], ends[free]


class Reader(dict):
    """A memo of stretch -> reading."""

    def __init__(self, model: CharModel):
        super().__init__()
        self.model = model

    def __missing__(self, stretch: bytes) -> bytes:
        read = decode(stretch, self.model)
        if len(stretch) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[stretch] = read
        return read

    def restored(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with every disguised stretch read, the rest as it is; A-Z are lower-cased. A blank byte is put between
        texts, so that no stretch reaches from one into the next."""
        sizes = np.diff(offsets)
        apart = np.zeros(len(raw) + len(sizes), np.uint8)
        apart[np.arange(len(raw)) + np.repeat(np.arange(len(sizes)), sizes)] = _LOWER[raw]
        ends = offsets[1:] + np.arange(len(sizes))  # of the blanks
        held = apart.tobytes()
        pieces, at, grown = [], 0, np.zeros(len(apart) + 1, np.int64)
        for a, b in zip(*(x.tolist() for x in stretches(apart)), strict=True):
            read = self[held[a:b]]
            pieces += [held[at:a], read]
            grown[b] += len(read) - (b - a)
            at = b
        out = np.frombuffer(b"".join([*pieces, held[at:]]), np.uint8)
        return out, ends + np.cumsum(grown)[ends] if len(ends) else ends


def restore(df: DataFrame, model: CharModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with the restored text, lower-cased."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # CELLS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for b in slices(batches):
            out, ends = reader.restored(*byte_view(b["text"]))
            held, first = out.tobytes(), np.concatenate([[0], ends[:-1] + 1])
            texts = [held[x:y].decode("utf-8") for x, y in zip(first.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    batch_size(df.sparkSession)
    return narrow(df, id_col, text_col).mapInArrow(run, "doc_id long, text string")


# --- Scores ---

BEGINNINGS = range(3, 8)  # bytes of a word's beginning; up to seven, and what kind of feature, fit into 64 bits
WHOLE, LEVEL = 8, 32  # added to the number of bytes: of a whole word; for each level of frequency
LEVELS = (1, 2, 4)  # times in a document; the last level is twice at least, and once in FREQUENT words
FREQUENT = 128


def features(out: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text and value of the beginnings of all words, and of whole words of up to seven bytes, block by block."""
    for a, b in _blocks(lambda x: ~_LETTER[x], out):
        yield _features(out[a:b], ends - a)


def _features(out: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, stops = _runs(_LETTER[out])
    text = np.searchsorted(ends, starts)
    size = stops - starts
    padded = np.concatenate([out, np.zeros(8, np.uint8)])
    value, docs, values = np.zeros(len(starts), np.uint64), [], []
    for k in range(1, max(BEGINNINGS) + 1):
        value = (value << np.uint64(8)) | np.where(size >= k, padded[starts + k - 1], 0).astype(np.uint64)
        if k in BEGINNINGS:
            for kind, there in ((k, size >= k), (WHOLE + k, size == k)):
                docs.append(text[there])
                values.append((value[there] << np.uint64(8)) | np.uint64(kind))
    return np.concatenate(docs), np.concatenate(values)


def counted(docs: np.ndarray, values: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of text and value once, with how often it occurs."""
    order = np.lexsort((values, docs))
    docs, values = docs[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])])) if len(docs) else np.zeros(0, int)
    n = np.diff(np.append(first, len(docs))) if n is None else np.add.reduceat(n[order], first) if len(first) else n
    return docs[first], values[first], n


def counts_of(blocks: Iterator[tuple[np.ndarray, np.ndarray]], texts: int, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text and value of the features with their levels: those of whole texts, block by block; wanted says which values count."""
    words, parts = np.zeros(texts, np.int64), [(np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int))]
    for docs, values in blocks:
        words += np.bincount(docs[(values & np.uint64(255)) == BEGINNINGS[0]], minlength=texts)
        if wanted:
            kept = wanted(values)
            docs, values = docs[kept], values[kept]
        parts.append(counted(docs, values))
    docs, values, n = counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    levels = [n >= k for k in LEVELS] + [(n > 1) & (n * FREQUENT >= words[docs])]
    return np.concatenate([docs[x] for x in levels]), np.concatenate([values[x] + np.uint64(i * LEVEL) for i, x in enumerate(levels)])


@dataclass
class Model:
    characters: CharModel
    values: np.ndarray  # sorted feature values
    weights: np.ndarray
    bias: float
    known: bool  # whether two labels were seen


_MIX = np.uint64(0x9E3779B97F4A7C15)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.reader = model, Reader(model.characters)
        self.plain = np.unique(model.values & ~np.uint64(3 * LEVEL))  # the values without their levels
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._cell(self.plain)] = True

    @staticmethod
    def _cell(values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (values * _MIX) >> np.uint64(44)

    @staticmethod
    def _place(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(among, values), len(among) - 1)
        return place, among[place] == values

    def _wanted(self, values: np.ndarray) -> np.ndarray:
        near = np.flatnonzero(self.seen[self._cell(values)])
        return near[self._place(values[near], self.plain)[1]]

    def found(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, place of the feature), each once, in the order of texts."""
        if not len(self.plain):
            return np.zeros(0, int), np.zeros(0, int)
        docs, values = counts_of(features(*self.reader.restored(raw, offsets)), len(offsets) - 1, self._wanted)
        place, hit = self._place(values, self.model.values)
        order = np.argsort(docs[hit], kind="stable")
        return docs[hit][order], place[hit][order]

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        docs, place = self.found(raw, offsets)
        x = self.model.bias + np.bincount(docs, self.model.weights[place], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _tied(with_one: np.ndarray, with_none: np.ndarray, ones: int, nones: int) -> np.ndarray:
    """The likelihood ratio of a feature's tie to the label."""

    def part(n: np.ndarray, total: np.ndarray | int) -> np.ndarray:
        return np.where(n > 0, n * np.log(np.maximum(n, 1) / total), 0.0)

    every, all_ = with_one + with_none, ones + nones
    own = part(with_one, every) + part(with_none, every) + part(ones - with_one, all_ - every + 1e-9) + part(nones - with_none, all_ - every + 1e-9)
    return 2 * (own - part(np.array(ones), all_) - part(np.array(nones), all_))


def regression(docs: np.ndarray, place: np.ndarray, labels: np.ndarray, width: int, penalty: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression with a quadratic penalty by accelerated gradient steps; both labels weigh the same."""
    n = len(labels)
    each = np.where(labels, 0.5 * n / max(1, labels.sum()), 0.5 * n / max(1, n - labels.sum()))
    w, bias, last = np.zeros(width), 0.0, (np.zeros(width), 0.0)
    held = np.bincount(docs, minlength=n)
    longest = np.bincount(place, each[docs] * (held[docs] + 1), minlength=width).max(initial=1.0)
    step = 1.0 / (0.25 * max(longest, (each * (held + 1)).sum()) + penalty)
    for t in range(rounds):
        v, b = w + t / (t + 3) * (w - last[0]), bias + t / (t + 3) * (bias - last[1])
        last = (w, bias)
        x = b + np.bincount(docs, v[place], minlength=n)
        off = each * (1 / (1 + np.exp(-np.clip(x, -500, 500))) - labels)
        w, bias = v - step * (np.bincount(place, off[docs], minlength=width) + penalty * v), b - step * off.sum()
    return w, float(bias)


def sample_of(docs: DataFrame, labels: DataFrame, per_label: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(key, text, label) of about per_label distinct texts of each label, every label but 0 being 1. Only ids and hashes
    are shuffled for it; of texts, those of the sample alone are, and copies count once, so that a group of copies
    neither fills the sample nor ties its own words to its label."""
    rows = narrow(docs, id_col, text_col).filter("text is not null").select("doc_id", "text", F.xxhash64("text").alias("mark"))
    given = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) != 0).alias("label")).filter("label is not null")
    marked = rows.select("doc_id", "mark").join(given, "doc_id").groupBy("mark", "label").agg(F.min("doc_id").alias("doc_id"))
    marked = written(marked, "marked")
    sizes = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0).cast("long")
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, F.lit(min(1 << 62, (per_label << 62) // n))).otherwise(share)
    drawn = marked.filter(F.shiftrightunsigned(F.xxhash64("mark"), 2) < share)
    found = rows.join(F.broadcast(drawn), ["doc_id", "mark"])  # about per_label rows a label
    return written(found.groupBy(F.col("mark").alias("key"), "label").agg(F.first("text").alias("text")), "sample")


def fit(docs: DataFrame, labels: DataFrame, characters: CharModel, per_label: int = PER_LABEL, significant: float = 20.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the labels (id_col, label_col) of the documents that have one."""
    sample = sample_of(docs, labels, per_label, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(characters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for b in slices(batches, 1 << 20):
            docs, values = counts_of(features(*reader.restored(*byte_view(b["text"]))), b.num_rows)
            one = b["label"].to_numpy(zero_copy_only=False)
            kinds, place, n = np.unique(values, return_inverse=True, return_counts=True)
            ones = np.bincount(place, one[docs], minlength=len(kinds)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n), pa.array(ones)], ["value", "n", "ones"])

    drawn = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, nones = drawn.get(True, 0), drawn.get(False, 0)
    if not ones or not nones:
        return Model(characters, np.zeros(0, np.uint64), np.zeros(0), 0.0, False)
    counted = sample.select("text", "label").mapInArrow(count, "value long, n long, ones long").groupBy("value").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    table = counted.filter("n >= 5").toArrow()  # bounded by the sample
    with_one = table["ones"].to_numpy().astype(float)
    tie = _tied(with_one, table["n"].to_numpy() - with_one, ones, nones)
    values = np.sort(table["value"].to_numpy()[tie > significant].view(np.uint64))
    plain = Model(characters, values, np.zeros(len(values)), 0.0, True)
    held = docs.sparkSession.sparkContext.broadcast(plain)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in slices(batches, 1 << 20):
            docs, place = scorer.found(*byte_view(b["text"]))
            cut = np.searchsorted(docs, np.arange(b.num_rows + 1))
            places = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(place, pa.int32()))
            yield pa.RecordBatch.from_arrays([b["key"], b["label"], places], ["key", "label", "places"])

    seen = sample.mapInArrow(found, "key long, label boolean, places array<int>").orderBy("key", "label").toArrow()  # the sample's rows
    places = seen["places"].combine_chunks()
    labels = seen["label"].to_numpy().astype(bool)
    sizes_ = np.diff(places.offsets.to_numpy()) if len(places) else np.zeros(0, int)
    weights, bias = regression(np.repeat(np.arange(len(labels)), sizes_), places.flatten().to_numpy(), labels, len(values))
    return Model(characters, values, weights, bias, True)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # CELLS floats, and features of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in slices(batches):
            scores = scorer.scores(*byte_view(b["text"])) if scorer.model.known else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(scores)], ["doc_id", "score"])

    batch_size(df.sparkSession)
    return narrow(df, id_col, text_col).mapInArrow(run, "doc_id long, score double")
