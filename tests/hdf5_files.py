"""Writes small NetCDF-4 files for tests: a root group by symbol table or by links, chunked and contiguous datasets."""

import struct
import zlib

import numpy as np

NOWHERE = (1 << 64) - 1


def pad(b: bytes, n: int = 8) -> bytes:
    return b + b"\0" * (-len(b) % n)


def number_type(dtype: np.dtype) -> bytes:
    dtype = np.dtype(dtype)
    if dtype.kind == "f":
        exponent, mantissa = (8, 23) if dtype.itemsize == 4 else (11, 52)
        big = dtype.str[0] == ">"
        return struct.pack("<BBBBI", 0x11, 0x20 | big, dtype.itemsize * 8 - 1, 0, dtype.itemsize) + struct.pack("<HHBBBBI", 0, dtype.itemsize * 8, mantissa, exponent, 0, mantissa, (1 << (exponent - 1)) - 1)
    return struct.pack("<BBBBI", 0x10, (8 if dtype.kind == "i" else 0) | (dtype.str[0] == ">"), 0, 0, dtype.itemsize) + struct.pack("<HH", 0, dtype.itemsize * 8)


def space(shape: tuple) -> bytes:
    return struct.pack("<BBB5x", 1, len(shape), 0) + b"".join(struct.pack("<Q", n) for n in shape)


def attribute(name: str, of: bytes, shape: tuple, data: bytes) -> bytes:
    sizes = struct.pack("<HHH", len(name) + 1, len(of), len(space(shape)))
    return struct.pack("<BB", 1, 0) + sizes + pad(name.encode() + b"\0") + pad(of) + pad(space(shape)) + data


def text_attribute(name: str, value: str) -> bytes:
    return attribute(name, struct.pack("<BBBBI", 0x13, 0, 0, 0, len(value)), (), value.encode())


def header(messages: list[tuple[int, bytes]]) -> bytes:
    body = b"".join(struct.pack("<HHB3x", kind, len(pad(m)), 0) + pad(m) for kind, m in messages)
    return struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body


class File:
    def __init__(self):
        self.raw = bytearray(96)

    def put(self, b: bytes) -> int:
        self.raw += b"\0" * (-len(self.raw) % 8)
        at = len(self.raw)
        self.raw += b
        return at

    def chunks(self, data: np.ndarray, chunk: tuple, deflate: bool, shuffle: bool, fan_out: int) -> int:
        """The chunk B-tree over data, with at most fan_out children a node; chunks of nothing but NaN are left out."""
        entries = []
        for index in np.ndindex(*(-(-n // c) for n, c in zip(data.shape, chunk, strict=True))):
            offset = tuple(i * c for i, c in zip(index, chunk, strict=True))
            block = np.zeros(chunk, data.dtype)
            part = data[tuple(slice(o, o + c) for o, c in zip(offset, chunk, strict=True))]
            if part.dtype.kind == "f" and np.isnan(part).all():
                continue
            block[tuple(slice(0, n) for n in part.shape)] = part
            raw = block.tobytes()
            raw = np.frombuffer(raw, np.uint8).reshape(-1, data.dtype.itemsize).T.tobytes() if shuffle else raw
            raw = zlib.compress(raw) if deflate else raw
            entries.append((len(raw), offset, self.put(raw)))
        level, end = 0, (0, tuple(-(-n // c) * c for n, c in zip(data.shape, chunk, strict=True)))
        key = lambda size, offset: struct.pack("<II", size, 0) + b"".join(struct.pack("<Q", o) for o in offset) + struct.pack("<Q", 0)
        while True:
            groups = [entries[i : i + fan_out] for i in range(0, len(entries), fan_out)]
            after = [g[0][:2] for g in groups[1:]] + [end]
            nodes = [
                (g[0][0], g[0][1], self.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(g), NOWHERE, NOWHERE) + b"".join(key(s, o) + struct.pack("<Q", at) for s, o, at in g) + key(*last)))
                for g, last in zip(groups, after, strict=True)
            ]
            if len(nodes) == 1:
                return nodes[0][2]
            entries, level = nodes, level + 1


def netcdf4(variables: dict, dims: list[str], links: bool = False, filters: list[int] | None = None, fan_out: int = 3) -> bytes:
    """variables: name -> (dimensions, data, text attributes, chunk or None). Axes come first."""
    f, places = File(), {}
    for name, (axes, data, attrs, chunk) in variables.items():
        own = filters if filters is not None else [2, 1]
        messages = [(1, space(data.shape)), (3, number_type(data.dtype))]
        if chunk:
            tree = f.chunks(data, chunk, 1 in own, 2 in own, fan_out)
            messages.append((8, struct.pack("<BBBQ", 3, 2, data.ndim + 1, tree) + b"".join(struct.pack("<I", c) for c in (*chunk, data.dtype.itemsize))))
            described = b"".join(struct.pack("<HHHH", code, 0, 0, 1) + struct.pack("<I4x", 4) for code in own)
            messages.append((11, struct.pack("<BB6x", 1, len(own)) + described))
        else:
            at = f.put(data.tobytes())
            messages.append((8, struct.pack("<BBQQ", 3, 1, at, data.nbytes)))
        messages += [(12, text_attribute(k, v)) for k, v in attrs.items() if isinstance(v, str)]
        messages += [(12, attribute(k, number_type(v.dtype), v.shape, v.tobytes())) for k, v in attrs.items() if not isinstance(v, str)]
        if name not in dims:
            objects = b"".join(struct.pack("<HH4xQ", i + 1, 1, 8) + struct.pack("<Q", places[d]) for i, d in enumerate(axes))
            heap = f.put(b"GCOL" + struct.pack("<B3xQ", 1, 16 + len(objects) + 16) + objects + struct.pack("<HH4xQ", 0, 0, 0))
            reference = struct.pack("<BBBBI", 0x17, 0, 0, 0, 8)
            listed = struct.pack("<BBBBI", 0x19, 0, 0, 0, 16) + reference
            messages.append((12, attribute("DIMENSION_LIST", listed, (len(axes),), b"".join(struct.pack("<IQI", 1, heap, i + 1) for i in range(len(axes))))))
        places[name] = f.put(header(messages))
    if links:
        root = f.put(header([(6, struct.pack("<BBB", 1, 0, len(n)) + n.encode() + struct.pack("<Q", p)) for n, p in places.items()]))
    else:
        names = sorted(places)
        text, at = b"\0" * 8, {}
        for n in names:
            at[n] = len(text)
            text = pad(text + n.encode() + b"\0")
        held = f.put(text)
        heap = f.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(text), NOWHERE, held))
        node = f.put(b"SNOD" + struct.pack("<BBH", 1, 0, len(names)) + b"".join(struct.pack("<QQI4x16x", at[n], places[n], 0) for n in names))
        tree = f.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NOWHERE, NOWHERE) + struct.pack("<QQQ", 0, node, at[names[-1]]))
        root = f.put(header([(17, struct.pack("<QQ", tree, heap))]))
    f.raw[:96] = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, len(f.raw), NOWHERE) + struct.pack("<QQI4x16x", 0, root, 0)
    return bytes(f.raw)
