"""The part of HDF5 that NetCDF-4 files are made of, read by ranges: a box of a variable takes only the chunks that it meets.

Read are groups by symbol table or by links kept in the header, contiguous, compact and chunked layouts with a chunk B-tree,
and the deflate and shuffle filters. What a file has beyond that - other filters, dense link or attribute storage, newer
chunk indexes - is refused by name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np

from isohyet.sources.tables import LayoutError

#: The signature of a file, and the kinds of messages of object headers that are read.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
DATASPACE, LINK_INFO, DATATYPE, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUATION, SYMBOLS, ATTRIBUTE_INFO = 1, 2, 3, 6, 8, 11, 12, 16, 17, 21
FILTER_NAMES = {1: "deflate", 2: "shuffle", 3: "fletcher32", 4: "szip", 5: "nbit", 6: "scaleoffset"}
NOWHERE = (1 << 64) - 1
HIDDEN = ("This is a netCDF dimension but not a netCDF variable",)


class _Bytes:
    """Fields of a stretch of a file, one after another."""

    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, at

    def number(self, size: int) -> int:
        v = int.from_bytes(self.raw[self.at : self.at + size], "little")
        self.at += size
        return v

    def take(self, n: int) -> bytes:
        got = self.raw[self.at : self.at + n]
        self.at += n
        return got


def _type(b: _Bytes) -> tuple[str, object]:
    """(kind, what): a numpy dtype of a number, the size of a text, the base of a list, or the size of a reference."""
    first = b.at
    head, bits, size = b.number(1), b.number(3), b.number(4)
    kind = head & 15
    order = ">" if bits & 1 else "<"
    if kind == 0:
        b.at += 4
        return "number", np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")
    if kind == 1:
        b.at += 12
        return "number", np.dtype(f"{order}f{size}")
    if kind == 3:
        return "text", size
    if kind == 7:
        return "reference", size
    if kind == 9:
        return ("text list" if bits & 15 == 1 else "list"), _type(b)
    raise LayoutError(f"HDF5 data of class {kind} at {first} are not read")


def _shape(raw: bytes) -> list[int]:
    b = _Bytes(raw)
    version, rank, flags = b.number(1), b.number(1), b.number(1)
    b.at += 5 if version == 1 else 1
    return [b.number(8) for _ in range(rank)]


class _Dataset:
    def __init__(self, messages: list[tuple[int, bytes]]):
        found = dict(messages)
        self.shape = _shape(found[DATASPACE])
        kind, self.dtype = _type(_Bytes(found[DATATYPE]))
        self.numeric = kind == "number"
        self.filters: list[int] = []
        if FILTERS in found:
            b = _Bytes(found[FILTERS])
            version, n = b.number(1), b.number(1)
            b.at += 6 if version == 1 else 0
            for _ in range(n):
                code = b.number(2)
                length = b.number(2) if version == 1 or code >= 256 else 0
                b.number(2)
                values = b.number(2)
                b.at += -(-length // 8) * 8 if version == 1 else length
                b.at += 4 * values + (4 if version == 1 and values % 2 else 0)
                self.filters.append(code)
        b = _Bytes(found[LAYOUT])
        if (version := b.number(1)) != 3:
            raise LayoutError(f"an HDF5 layout of version {version} is not read")
        self.kind = b.number(1)
        self.begin, self.held, self.chunk = NOWHERE, b"", []
        if self.kind == 0:
            self.held = b.take(b.number(2))
        elif self.kind == 1:
            self.begin = b.number(8)
        else:
            rank = b.number(1)
            self.begin = b.number(8)
            self.chunk = [b.number(4) for _ in range(rank)][:-1]  # the last is the size of an element


class Hdf5:
    """Variables of a NetCDF-4 file: name -> (dimensions, shape, attributes, dtype)."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.file = read
        head = read(0, 96)
        version = head[8]
        if version in (0, 1):
            self.base = int.from_bytes(head[24 + 4 * (version == 1) :][:8], "little")
            root = int.from_bytes(head[64 + 4 * (version == 1) :][:8], "little")
            sizes = head[13:15]
        elif version in (2, 3):
            sizes, self.base, root = head[9:11], *struct.unpack_from("<q", head, 12), *struct.unpack_from("<q", head, 36)
        else:
            raise LayoutError(f"an HDF5 superblock of version {version} is not read")
        if sizes != b"\x08\x08":
            raise LayoutError("HDF5 offsets and lengths of other than 8 bytes are not read")
        self.places, self.sets, self._heaps = {}, {}, {}
        attributes: dict[str, dict] = {}
        for name, place in self._members(self._messages(root)):
            messages = self._messages(place)
            if any(k == LAYOUT for k, _ in messages):
                self.places[place], self.sets[name] = name, _Dataset(messages)
                attributes[name] = dict(self._attributes(messages))
        self.variables = {}
        for name, own in self.sets.items():
            attrs = attributes[name]
            if own.numeric and not str(attrs.get("NAME", "")).startswith(HIDDEN):
                axes = attrs.get("DIMENSION_LIST")
                dims = [name] if axes is None and len(own.shape) == 1 else [self.places.get(a[0], "") for a in axes or []]
                kept = {k: v for k, v in attrs.items() if k not in ("CLASS", "NAME", "DIMENSION_LIST", "REFERENCE_LIST")}
                self.variables[name] = (dims, own.shape, kept, own.dtype)

    def _read(self, at: int, n: int) -> bytes:
        return self.file(self.base + at, n)

    def _messages(self, place: int) -> list[tuple[int, bytes]]:
        """(kind, content) of all messages of an object header, continued blocks included."""
        head = self._read(place, 512)
        if head[:4] == b"OHDR":
            flags = head[5]
            at = 6 + (16 if flags & 32 else 0) + (4 if flags & 16 else 0)
            width = 1 << (flags & 3)
            size = int.from_bytes(head[at : at + width], "little")
            blocks, newer, tracked = [(place + at + width, size)], True, bool(flags & 4)
        else:
            blocks, newer, tracked = [(place + 16, int.from_bytes(head[8:12], "little"))], False, False
        out = []
        for begin, size in blocks:  # grows meanwhile
            b = _Bytes(self._read(begin, size))
            while b.at + (4 if newer else 8) <= size:
                kind, length, flags = (b.number(1), b.number(2), b.number(1)) if newer else (b.number(2), b.number(2), b.number(1))
                b.at += (2 if tracked else 0) if newer else 3
                content = b.take(length)
                if flags & 2:
                    raise LayoutError("shared HDF5 messages are not read")
                if kind == CONTINUATION:
                    start, n = struct.unpack("<qq", content[:16])
                    blocks.append((start + 4, n - 8) if newer else (start, n))
                else:
                    out.append((kind, content))
        return out

    def _members(self, messages: list[tuple[int, bytes]]) -> Iterator[tuple[str, int]]:
        """Names and places of a group's objects."""
        for kind, raw in messages:
            if kind == SYMBOLS:
                tree, heap = struct.unpack("<qq", raw[:16])
                names = struct.unpack("<q", self._read(heap, 32)[24:32])[0]
                for node in self._leaves(tree):
                    count = int.from_bytes(self._read(node, 8)[6:8], "little")
                    entries = self._read(node + 8, 40 * count)
                    for i in range(count):
                        offset, place = struct.unpack_from("<qq", entries, 40 * i)
                        yield self._text(names + offset), place
            elif kind == LINK:
                b = _Bytes(raw, 1)
                flags = b.number(1)
                hard = not flags & 8 or b.number(1) == 0
                b.at += (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
                name = b.take(b.number(1 << (flags & 3))).decode()
                if hard:
                    yield name, b.number(8)
            elif kind == LINK_INFO:
                flags = raw[1]
                if struct.unpack_from("<Q", raw, 2 + (8 if flags & 1 else 0))[0] != NOWHERE:
                    raise LayoutError("HDF5 links in dense storage are not read")

    def _text(self, at: int) -> str:
        raw, size = b"", 64
        while b"\0" not in raw:
            raw, size = self._read(at, size), size * 4
        return raw[: raw.index(b"\0")].decode()

    def _leaves(self, tree: int) -> Iterator[int]:
        """Symbol nodes of a group's B-tree."""
        head = self._read(tree, 24)
        level, n = head[5], int.from_bytes(head[6:8], "little")
        keys = self._read(tree + 24, 16 * n + 8)
        for i in range(n):
            child = struct.unpack_from("<q", keys, 16 * i + 8)[0]
            yield from self._leaves(child) if level else [child]

    def _attributes(self, messages: list[tuple[int, bytes]]) -> Iterator[tuple[str, object]]:
        for kind, raw in messages:
            if kind == ATTRIBUTE_INFO:
                if struct.unpack_from("<Q", raw, 2 + (2 if raw[1] & 1 else 0))[0] != NOWHERE:
                    raise LayoutError("HDF5 attributes in dense storage are not read")
            if kind != ATTRIBUTE:
                continue
            b = _Bytes(raw)
            version, _ = b.number(1), b.number(1)
            sizes = [b.number(2) for _ in range(3)]
            b.at += 1 if version == 3 else 0
            name, of, space = (b.take(-(-n // 8) * 8 if version == 1 else n) for n in sizes)
            try:
                what = _type(_Bytes(of))
            except LayoutError:
                continue  # the format's own bookkeeping
            yield name[: sizes[0]].split(b"\0")[0].decode(), self._value(what, _shape(space), b)

    def _value(self, what: tuple[str, object], shape: list[int], b: _Bytes):
        kind, of = what
        n = int(np.prod(shape, dtype=int))
        if kind == "number":
            return np.frombuffer(b.take(n * of.itemsize), of)
        if kind == "text":
            return b.take(n * of).decode("utf-8", "replace").rstrip("\0")
        if kind == "reference":
            return [b.number(8) for _ in range(n)]
        found = []
        for _ in range(n):
            length, heap, index = b.number(4), b.number(8), b.number(4)
            raw = self._heap(heap).get(index, b"")
            found.append(raw[:length].decode("utf-8", "replace") if kind == "text list" else list(self._value(of, [length], _Bytes(raw))))
        return found[0] if kind == "text list" and n == 1 else found

    def _heap(self, place: int) -> dict[int, bytes]:
        """Objects of a collection of the global heap by their number."""
        if place not in self._heaps:
            size = struct.unpack("<q", self._read(place, 16)[8:16])[0]
            b, found = _Bytes(self._read(place, size), 16), {}
            while b.at + 16 <= size:
                index, _, length = b.number(2), b.number(6), b.number(8)
                if not index:
                    break
                found[index] = b.take(-(-length // 8) * 8)[:length]
            self._heaps[place] = found
        return self._heaps[place]

    def _chunks(self, tree: int, own: _Dataset, box: list[tuple[int, int]]) -> Iterator[tuple[list[int], int, int, int]]:
        """(offset, place, size, mask) of the chunks that meet the box."""
        if tree == NOWHERE:
            return
        rank = len(own.shape)
        width = 8 + 8 * (rank + 1)
        head = self._read(tree, 24)
        level, n = head[5], int.from_bytes(head[6:8], "little")
        raw = self._read(tree + 24, n * (width + 8) + width)
        keys = [struct.unpack_from(f"<II{rank}q", raw, i * (width + 8)) for i in range(n + 1)]
        for i, (size, mask, *offset) in enumerate(keys[:-1]):
            child = struct.unpack_from("<q", raw, i * (width + 8) + width)[0]
            if level:
                if offset[0] < box[0][1] and keys[i + 1][2] + own.chunk[0] > box[0][0]:  # chunks are in the order of their offsets
                    yield from self._chunks(child, own, box)
            elif all(o < hi and o + c > lo for o, c, (lo, hi) in zip(offset, own.chunk, box, strict=True)):
                yield offset, child, size, mask

    def values(self, name: str, box: list[tuple[int, int]] | None = None) -> np.ndarray:
        """A variable's values, or those of a range of each dimension; cells that no chunk holds are NaN or 0."""
        own = self.sets[name]
        box = [(0, n) for n in own.shape] if box is None else [(max(0, a), min(b, n)) for (a, b), n in zip(box, own.shape, strict=True)]
        sizes = [max(0, b - a) for a, b in box]
        if own.kind == 0:
            return np.frombuffer(own.held, own.dtype, int(np.prod(own.shape, dtype=int))).reshape(own.shape)[tuple(slice(*x) for x in box)]
        if own.kind == 1:
            return np.zeros(sizes, own.dtype) if own.begin == NOWHERE else ranged(self._read, own.begin, own.dtype, own.shape, box)
        odd = [FILTER_NAMES.get(f, str(f)) for f in own.filters if f not in (1, 2)]
        if odd:
            raise LayoutError(f"the filter {odd[0]} is not read")
        out = np.full(sizes, np.nan if own.dtype.kind == "f" else 0, own.dtype)
        for offset, place, size, mask in self._chunks(own.begin, own, box):
            raw = self._read(place, size)
            for i, code in reversed(list(enumerate(own.filters))):
                if mask >> i & 1:
                    continue
                raw = zlib.decompress(raw) if code == 1 else np.frombuffer(raw, np.uint8).reshape(own.dtype.itemsize, -1).T.tobytes()
            block = np.frombuffer(raw, own.dtype, int(np.prod(own.chunk, dtype=int))).reshape(own.chunk)
            of, into = [], []
            for o, c, (lo, hi) in zip(offset, own.chunk, box, strict=True):
                a, b = max(o, lo), min(o + c, hi)
                of.append(slice(a - o, b - o))
                into.append(slice(a - lo, b - lo))
            out[tuple(into)] = block[tuple(of)]
        return out


def ranged(read: Callable[[int, int], bytes], begin: int, dtype: np.dtype, shape: list[int], box: list[tuple[int, int]], step: int | None = None) -> np.ndarray:
    """A box of an array that lies in one piece, or a step apart for each of its first dimension: for each of these, the
    range of the second dimension is read."""
    sizes = [max(0, b - a) for a, b in box]
    if not shape:
        return np.frombuffer(read(begin, dtype.itemsize), dtype, 1).reshape([])
    if not all(sizes):
        return np.zeros(sizes, dtype)
    n = int(np.prod(shape[1:], dtype=int))
    step = step or n * dtype.itemsize
    first, last = (0, n) if len(shape) < 2 else (x * (n // shape[1]) for x in box[1])
    rest = [] if len(shape) < 2 else [box[1][1] - box[1][0], *shape[2:]]
    cut = tuple(slice(a, b) for a, b in box[2:])
    if (first, last) == (0, n) and step == n * dtype.itemsize:
        data = np.frombuffer(read(begin + box[0][0] * step, sizes[0] * step), dtype, sizes[0] * n).reshape([sizes[0], *rest])
        return data[(slice(None), slice(None), *cut)] if len(shape) > 1 else data
    parts = [np.frombuffer(read(begin + k * step + first * dtype.itemsize, (last - first) * dtype.itemsize), dtype, last - first).reshape(rest) for k in range(*box[0])]
    data = np.stack(parts)
    return data[(slice(None), slice(None), *cut)] if len(shape) > 1 else data
