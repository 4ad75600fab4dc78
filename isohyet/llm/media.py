"""Media columns: byte payloads as PNG images, and low-frequency cosine-transform hashes of them.

A payload becomes an 8-bit grey image, 576 samples wide. PNG is written and read here, chunk by chunk: every chunk's
checksum is tested, the data are inflated by zlib and the five scan-line filters are undone with numpy. The writer gives
each line the filter with the least sum of absolute values; the reader undoes the filters of many images at once, along
anti-diagonals, as a sample needs those to its left, above it and between. The hash holds the signs of the 8 x 8 lowest
cosine coefficients of the image, averaged to 32 x 32, against their median.

Rows: a null text is an empty payload, which is padded to one line. Equal texts have equal values. Repeated rows and
ids change nothing; an empty table gives an empty table; extra columns are left out. A damaged image raises
ValueError. Payloads of any length are stored whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from isohyet.llm.common import batch_size, narrow, slices

WIDTH, PAD = 576, 255
#: Fixed value: the signature of PNG files.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SIDE, _LOW = 32, 8
_COSINE = np.cos(np.pi * np.outer(np.arange(_LOW), np.arange(_SIDE) + 0.5) / _SIDE)


def padded(raw: bytes) -> bytes:
    return raw + bytes([PAD]) * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of the three neighbours the nearest to left + up - corner."""
    to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    return np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))


def filtered(lines: np.ndarray, first: np.ndarray, block: int = 4096) -> np.ndarray:
    """Scan lines with a byte for their filter before them; lines of several images may follow each other, `first` marks
    the top line of each."""
    out = np.zeros((len(lines), lines.shape[1] + 1), np.uint8)
    for at in range(0, len(lines), block):
        own = lines[at : at + block]
        up = np.zeros(own.shape, np.int16)
        up[1:] = own[:-1]
        up[0] = lines[at - 1] if at else 0
        up[first[at : at + block]] = 0
        left, corner = np.zeros_like(up), np.zeros_like(up)
        left[:, 1:], corner[:, 1:] = own[:, :-1], up[:, :-1]
        least = np.full(len(own), np.iinfo(np.int64).max)
        for kind, guess in enumerate((np.int16(0), left, up, (left + up) >> 1, _paeth(left, up, corner))):
            coded = (own - guess).astype(np.uint8)
            cost = np.minimum(coded, np.uint8(0) - coded).sum(1, dtype=np.int64)
            better = cost < least
            least[better] = cost[better]
            out[at : at + block][better] = np.column_stack([np.full(int(better.sum()), kind, np.uint8), coded[better]])
    return out


def write_images(payloads: list[bytes], level: int = 1) -> list[bytes]:
    """An image of each payload, whose lengths must be multiples of the width."""
    heights = np.array([len(p) // WIDTH for p in payloads], np.int64)
    ends = np.cumsum(heights)
    first = np.zeros(int(heights.sum()), bool)
    first[(ends - heights)[heights > 0]] = True
    data = filtered(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH), first)
    out = []
    for n, end in zip(heights.tolist(), ends.tolist(), strict=True):
        header = struct.pack(">IIBBBBB", WIDTH, n, 8, 0, 0, 0, 0)
        out.append(SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(data[end - n : end].tobytes(), level)) + _chunk(b"IEND", b""))
    return out


def write_png(payload: bytes, level: int = 1) -> bytes:
    return write_images([payload], level)[0]


def chunks(image: bytes) -> Iterator[tuple[bytes, bytes]]:
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at = 8
    while at < len(image):
        if at + 12 > len(image):
            raise ValueError("a PNG chunk is cut short")
        n, kind = struct.unpack_from(">I4s", image, at)
        data = image[at + 8 : at + 8 + n]
        if len(data) != n or struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError(f"the checksum of PNG chunk {kind!r} is wrong")
        yield kind, data
        at += 12 + n


def unfilter(kinds: np.ndarray, lines: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Undo the filters of 8-bit grey scan lines; `first` marks the top line of each image.

    In step t all lines get their sample t - y, y being a line's place in its image: what it needs is then there."""
    if (kinds > 4).any():
        raise ValueError(f"unknown PNG filter {int(kinds.max())}")
    n, width = lines.shape
    if not n or not kinds.any():
        return lines
    number = np.arange(n)
    y = number - np.maximum.accumulate(np.where(first, number, 0))
    order = np.argsort(y, kind="stable")  # lines at work in a step lie side by side
    place = np.empty(n, np.int64)
    place[order] = number
    above = np.where(first, n, place[number - 1])[order]  # place n is what lies over an image: always 0
    kinds, y = kinds[order], y[order]
    raw, out = np.ascontiguousarray(lines).ravel(), np.empty(n * width, np.uint8)
    base = order * width - y
    last, before = np.zeros(n + 1, np.int16), np.zeros(n + 1, np.int16)  # each line's newest two samples
    steps = np.arange(width + int(y[-1]))
    for t, low, high in zip(steps, np.searchsorted(y, steps - width, "right"), np.searchsorted(y, steps, "right"), strict=True):
        at = base[low:high] + t
        left, up, corner = last[low:high], last[above[low:high]], before[above[low:high]]
        guess = np.choose(kinds[low:high], (np.int16(0), left, up, (left + up) >> 1, _paeth(left, up, corner)))
        found = (raw[at] + guess) & 255
        out[at] = found
        before[low:high] = left
        last[low:high] = found
    return out.reshape(n, width)


def _inflated(image: bytes) -> tuple[int, np.ndarray]:
    """The width of an 8-bit grey image, and its lines with their filters before them."""
    shape, data, ended = None, [], False
    for kind, body in chunks(image):
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit grey images without interlacing are read")
            shape = (height, width)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
    if shape is None or not ended:
        raise ValueError("a PNG image without header or end")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if raw.size != shape[0] * (shape[1] + 1):
        raise ValueError("a PNG image has the wrong number of samples")
    return shape[1], raw.reshape(shape[0], shape[1] + 1)


def read_images(images: list[bytes]) -> list[np.ndarray]:
    """The samples of 8-bit grey images, as (height, width) arrays."""
    found = [_inflated(x) for x in images]
    out: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(found)
    for width in {w for w, _ in found}:
        own = [i for i, (w, _) in enumerate(found) if w == width]
        lines = np.concatenate([found[i][1] for i in own])
        ends = np.cumsum([len(found[i][1]) for i in own])
        first = np.zeros(len(lines), bool)
        first[[int(e) - len(found[i][1]) for i, e in zip(own, ends, strict=True) if len(found[i][1])]] = True
        samples = unfilter(lines[:, 0], lines[:, 1:], first)
        for i, end in zip(own, ends.tolist(), strict=True):
            out[i] = samples[end - len(found[i][1]) : end]
    return out


def read_png(image: bytes) -> np.ndarray:
    return read_images([image])[0]


def _shrunk(samples: np.ndarray) -> np.ndarray:
    """Means over a 32 x 32 grid; lines and columns repeat where there are fewer than 32."""
    rows, columns = (np.arange(_SIDE + 1) * n // _SIDE for n in samples.shape)
    sums = np.zeros((samples.shape[0] + 1, samples.shape[1] + 1), np.int64)
    np.cumsum(samples, axis=0, out=sums[1:, 1:], dtype=np.int64)
    np.cumsum(sums[1:, 1:], axis=1, out=sums[1:, 1:])
    top, left = np.minimum(rows[:-1], samples.shape[0] - 1), np.minimum(columns[:-1], samples.shape[1] - 1)
    low, right = np.maximum(rows[1:], top + 1), np.maximum(columns[1:], left + 1)
    total = sums[np.ix_(low, right)] - sums[np.ix_(top, right)] - sums[np.ix_(low, left)] + sums[np.ix_(top, left)]
    return total / np.outer(low - top, right - left)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the lowest 8 x 8 cosine coefficients lie above their median, the constant one apart. Coefficients
    are rounded, so that those of even images are 0 and not what is left of their sums."""
    low = np.round(_COSINE @ _shrunk(samples) @ _COSINE.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def store(df: DataFrame, level: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media BINARY): each whole text as an image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = [(t or "").encode() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([len(r) for r in raw], pa.int64()), pa.array(write_images([padded(r) for r in raw], level), pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    batch_size(df.sparkSession)
    return narrow(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def load(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, payload BINARY, feature BINARY) read back from the stored images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            samples = read_images(b["media"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["n_bytes"], b["media"], pa.array([s.tobytes() for s in samples], pa.binary()), pa.array([cosine_hash(s) for s in samples], pa.binary())],
                ["doc_id", "n_bytes", "media", "payload", "feature"],
            )

    batch_size(df.sparkSession)
    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, feature binary")
