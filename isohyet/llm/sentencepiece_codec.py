"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

For every prefix of a word the table stores the one token that ends the prefix's encoding. An automaton over
all pieces lists the tokens that end at a position; the last of them is the one whose neighbour - the token
stored for the shorter prefix - would not have merged across the seam. The ids are then read off backwards. A model with
a normaliser or with pieces that a user has defined is refused.

Rows: a null text counts as empty and has no ids. Each row stands alone, so ties, repeated rows and repeated ids
change nothing; an empty table gives an empty table. Extra columns are left out.
"""

from __future__ import annotations

import functools
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from isohyet.llm.common import batch_size, narrow, slices, tokenizer_path

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
MEMO_WORDS = 500_000  # words that a worker remembers at once; a bound on memory only
NEVER = float("inf")
_PROBE = "\ufb01 \uff21  x "  # what normalisers change: a ligature, a wide letter, spaces in a row and at the end


class PrefixTableCodec:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if model.normalize(_PROBE) != SPACE + _PROBE.replace(" ", SPACE):
            raise ValueError("only models that leave texts as they are, but for a space before them, are encoded here")
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        ordinary = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if sum(model.get_score(i) == 0 for i in ordinary) > 1:
            raise ValueError("models with pieces that a user has defined are not encoded here")
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.ids = {self.pieces[i]: i for i in ordinary}
        self.rank = {self.pieces[i]: -model.get_score(i) for i in ordinary}
        for byte, i in enumerate(self.byte_ids):
            self.pieces[i] = bytes([byte])
        self.raw = [p if isinstance(p, bytes) else p.replace(SPACE, " ").encode() for p in self.pieces]
        self.spines: dict[str, tuple[list, list] | None] = {}
        self.memo: dict[str, bytes] = {}
        self._automaton([p for p in self.ids if p.strip(SPACE) or p == SPACE])

    # The automaton: a state is (transitions, candidates, single): the longer pieces that end there, longest first, each
    # with what is known of the tokens before it, and the piece of the last character alone.
    def _automaton(self, words: list[str]) -> None:
        step: list[dict[str, int]] = [{}]
        own: list[int] = [-1]
        text = [""]
        for word in words:
            s = 0
            for c in word:
                if c not in step[s]:
                    step[s][c] = len(step)
                    step.append({})
                    own.append(-1)
                    text.append(text[s] + c)
                s = step[s][c]
            own[s] = self.ids[word]
        known: dict[int, dict[int, bool]] = {i: {} for i in own}
        back = [0] * len(step)
        ends: list[tuple] = [()] * len(step)
        queue = deque(step[0].values())
        while queue:
            s = queue.popleft()
            mine = ((known[own[s]], len(text[s]), own[s]),) if own[s] >= 0 and len(text[s]) > 1 else ()
            ends[s] = mine + ends[back[s]]
            for c, t in step[s].items():
                b = back[s]
                while b and c not in step[b]:
                    b = back[b]
                if s:
                    back[t] = step[b].get(c, 0)
                queue.append(t)
        self.states = [({}, ends[s], self._single(text[s][-1:])) for s in range(len(step))]
        for s, moves in enumerate(step):
            self.states[s][0].update((c, self.states[t]) for c, t in moves.items())
        self.shorter = {id(self.states[s]): self.states[b] for s, b in enumerate(back)}
        self.start = self.states[0]

    def _single(self, c: str) -> int:
        """The id of a character's own piece; a character without one gets a negative number."""
        return self.ids[c] if c in self.ids else -2 - ord(c) if c else -1

    def _next(self, state: tuple, c: str) -> tuple:
        """The state after c, found through the shorter suffixes and remembered."""
        at = state
        while c not in at[0] and at is not self.start:
            at = self.shorter.get(id(at), self.start)
        found = at[0].get(c)
        if found is None:
            return (self.start[0], (), self._single(c))
        state[0][c] = found
        return found

    def _merges(self, piece: str) -> list[tuple[int, int, int]]:
        """How the piece's own characters merge: (start, middle, end) of each merge in turn."""
        cuts, done = list(range(len(piece) + 1)), []
        while len(cuts) > 2:
            best = min(((self.rank[w], i) for i in range(len(cuts) - 2) if (w := piece[cuts[i] : cuts[i + 2]]) in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            done.append((cuts[i], cuts[i + 1], cuts[i + 2]))
            del cuts[i + 1]
        return done

    def _spine(self, piece: str) -> tuple[list, list] | None:
        """The symbols that stood at the piece's left and right edge, each as (symbol, from, until): the ranks of the
        merge that made it and of the one that took it up. None where the characters do not end as this piece."""
        if piece not in self.spines:
            left, right = [[piece[0], -NEVER, NEVER]], [[piece[-1], -NEVER, NEVER]]
            for start, _, end in self._merges(piece):
                whole = piece[start:end]
                for chain in (left,) * (start == 0) + (right,) * (end == len(piece)):
                    chain[-1][2] = self.rank[whole]
                    chain.append([whole, self.rank[whole], NEVER])
            self.spines[piece] = (left, right) if left[-1][0] == piece else None
        return self.spines[piece]

    def fit(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand side by side: no symbols at the seam would ever merge across it. Nothing
        before (-1) and characters without a piece (below -1) fit everything that is a token by its own merges."""
        spine = self._spine(self.pieces[right])
        if spine is None or left < 0:
            return spine is not None
        for u, u_from, u_until in self._spine(self.pieces[left])[1]:
            for v, v_from, v_until in spine[0]:
                across = self.rank.get(u + v)
                if across is not None and u_from < v_until and v_from < u_until and across < u_until and across <= v_until:
                    return False
        return True

    def tokens(self, word: str) -> list[int]:
        """The tokens of one word that starts with the space mark; a character without a piece is a negative number."""
        state, last = self.start, [-1]
        store = last.append
        for i, c in enumerate(word, 1):
            state = state[0].get(c) or self._next(state, c)
            for known, n, piece in state[1]:
                before = last[i - n]
                fits = known.get(before)
                if fits is None:
                    fits = known[before] = self.fit(before, piece)
                if fits:
                    store(piece)
                    break
            else:
                store(state[2])
        out, at, pieces = [], len(word), self.pieces
        while at:
            token = last[at]
            out.append(token)
            at -= len(pieces[token]) if token >= 0 else 1
        out.reverse()
        return out

    def _as_ids(self, tokens: list[int]) -> list[int]:
        if min(tokens) >= 0:
            return tokens
        return [i for t in tokens for i in ([t] if t >= 0 else [self.byte_ids[b] for b in chr(-2 - t).encode()])]

    def word(self, word: str) -> bytes:
        """Little-endian 32-bit ids of a space mark and the word, remembered."""
        found = self.memo.get(word)
        if found is None:
            if word[-2:] in self.apart:  # such a mark never joins what stands before it
                return self.word(word[:-1]) + self.marks[word[-1]]
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            found = array("i", self._as_ids(self.tokens(SPACE + word))).tobytes()
            if len(word) <= 64:
                self.memo[word] = found
        return found

    @functools.cached_property
    def marks(self) -> dict[str, bytes]:
        return {c: array("i", [self.ids[c]]).tobytes() for c in ".,;:!?" if c in self.ids}

    @functools.cached_property
    def apart(self) -> set[str]:
        """Pairs of an ASCII letter and a mark that no piece holds side by side."""
        held = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        return {a + c for a in map(chr, range(33, 127)) if a.isalpha() for c in self.marks} - held

    def spaces(self, n: int) -> list[str]:
        """Space marks have one score for every length: they merge from the left, as far as pieces exist."""
        parts = [SPACE] * n
        i = 0
        while i + 1 < len(parts):
            if parts[i] + parts[i + 1] in self.ids:
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                i = max(0, i - 1)
            else:
                i += 1
        return parts

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if not text:
            return b""
        words = text.replace(SPACE, " ").split(" ")
        if "" not in words:
            return b"".join(map(self.word, words))
        out, run = [], 0
        for w in words:
            run += 1
            if not w:
                continue
            ids = self.word(w)
            if run > 1:
                alone = ids[:4] == self._space_id
                out.append(np.array([self.ids[p] for p in self.spaces(run - (not alone))], "<i4").tobytes())
                ids = ids[4:] if alone else ids
            out.append(ids)
            run = 0
        if run:
            out.append(np.array([self.ids[p] for p in self.spaces(run)], "<i4").tobytes())
        return b"".join(out)

    @functools.cached_property
    def _space_id(self) -> bytes:
        return np.array([self.ids[SPACE]], "<i4").tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the one space that encoding puts in front."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> PrefixTableCodec:
    return PrefixTableCodec(path)


def encode(df: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids ARRAY<INT>) of every whole text."""
    path = tokenizer_path(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in slices(batches):
            raw = [own.encode(t or "") for t in b["text"].to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype("int32")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([b["doc_id"], lists], ["doc_id", "ids"])

    batch_size(df.sparkSession)
    return narrow(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text) of ids made by encode(); null ids give an empty text."""
    path = tokenizer_path(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in slices(batches):
            texts = pa.array([own.decode(x or ()) for x in b["ids"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["ids"], texts], ["doc_id", "ids", "text"])

    batch_size(df.sparkSession)
    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{ids_col}` as array<int>) ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
