"""Byte-level BPE ids of whole texts, as the tokenizers library makes them for the same vocabulary.

A single space between two other characters always starts a new pre-token, so texts are cut there and the ids of
each stretch are remembered. Texts with white space on both sides of a space are encoded whole. Stretches are
encoded by tiktoken, whose ranks are read from the tokenizers file; texts with more than LONG_SPACE white-space characters
in a row, over which its pattern runs out of stack, are encoded by the tokenizers library itself. Special tokens in a
text keep their own ids. A file that asks for anything else - a normaliser, another cut into pre-tokens, another order of
merges - is refused.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

from isohyet.llm.common import tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
MEMO_STRETCHES = 150_000  # stretches that a worker remembers at once; a bound on memory only
#: The pre-token pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_AMBIGUOUS = re.compile(r"\s \s")
LONG_SPACE = 10_000


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def check_spec(spec: dict) -> None:
    """Refuse a tokenizers file whose ids would not be those that are made here."""
    cut, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback") if model.get(k)]
    if spec["normalizer"] or not plain or model["type"] != "BPE" or odd:
        raise ValueError("only byte-level BPE without a normaliser and with the usual pre-tokens is encoded here")
    made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        raise ValueError("the merges are not in the order of their ids")


def long_space(text: str) -> bool:
    """Whether a text has so long a run of white space: each covers one of the blocks of half its length."""
    half = LONG_SPACE // 2
    return any(text[i].isspace() and text[i : i + half].isspace() for i in range(0, len(text) - half + 1, half))


class ByteBpe(dict):
    """A memo of stretch -> little-endian 32-bit ids, with the encoder behind it."""

    def __init__(self, path: str):
        super().__init__()
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_spec(spec)
        byte_of = _byte_of()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        self.path = path
        self.size = len(ranks) + len(self.special)
        self._encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self._plain = self._encoding.encode_ordinary
        self._cut = re.compile("|".join(re.escape(s) for s in self.special)) if self.special else None

    def __missing__(self, stretch: str) -> bytes:
        ids = array("I", self._plain(stretch)).tobytes()
        if len(stretch) <= 64:
            if len(self) >= MEMO_STRETCHES:
                self.clear()
            self[stretch] = ids
        return ids

    @functools.cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if long_space(text):
            return array("I", self._library.encode(text, add_special_tokens=False).ids).tobytes()
        if self._cut and self._cut.search(text):
            return array("I", self._encoding.encode(text, allowed_special="all")).tobytes()
        if _AMBIGUOUS.search(text):
            return array("I", self._plain(text)).tobytes()
        first, *rest = text.split(" ")
        return self[first] + b"".join(map(self.__getitem__, [" " + w for w in rest]))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    return tokenizer_path(name)
