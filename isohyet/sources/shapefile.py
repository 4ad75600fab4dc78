"""Shapefiles as a Spark data source: the index file gives the place of every record, so records are split by number.

A partition is a range of record numbers: its task reads that stretch of the index, the one stretch of geometries that it
names, and the stretch of fixed-width attribute rows beside it. Each record gives (record, properties, rings) as a GeoJSON
reader does: properties as text by name, and the rings of all parts, holes among them, in the order of the file. A null
shape has no rings, a point one ring of one point. Rows marked as deleted are left out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, datasource

from isohyet.sources.files import listed, opened, reachable
from isohyet.sources.tables import LayoutError

SCHEMA = "record long, properties map<string,string>, rings array<array<struct<x: double, y: double>>>"
RECORDS = 10_000  # of a task
#: Shape types by what they hold; each has a form with heights and one with measures.
EMPTY, POINTS, LINES, SETS = (0,), (1, 11, 21), (3, 5, 13, 15, 23, 25), (8, 18, 28)
#: Names of encodings in .cpg files, and what they are called here; others are taken as they stand.
ENCODINGS = {"65001": "utf-8", "1252": "cp1252", "88591": "latin-1", "ANSI 1252": "cp1252"}


@dataclass
class Fields:
    """The attribute table's header: first row's place, bytes of a row, and (name, kind, width, decimals) of the fields."""

    begin: int
    size: int
    fields: list[tuple[str, str, int, int]]
    encoding: str

    def row(self, raw: bytes) -> dict[str, str | None] | None:
        """The properties of a row; none if it is marked as deleted."""
        if raw[:1] == b"*":
            return None
        out, at = {}, 1
        for name, kind, width, decimals in self.fields:
            out[name] = _property(raw[at : at + width].decode(self.encoding, "replace").strip("\0 "), kind, decimals)
            at += width
        return out


def _property(text: str, kind: str, decimals: int) -> str | None:
    """The text that a GeoJSON document has for a value: numbers without padding, dates with hyphens, booleans by name."""
    if kind in "NF":
        if not text or set(text) == {"*"}:
            return None
        return text.lstrip("+") if not decimals and "." not in text and "e" not in text.lower() else repr(float(text))
    if kind == "L":
        return "true" if text in tuple("YyTt") else "false" if text in tuple("NnFf") else None
    if kind == "D":
        return f"{text[:4]}-{text[4:6]}-{text[6:8]}" if text.isdigit() else None
    return text


def fields_of(read, encoding: str) -> Fields:
    begin, size = struct.unpack("<HH", read(8, 4))
    head = read(0, begin)
    found = []
    for at in range(32, begin - 1, 32):
        if head[at] == 0x0D:
            break
        found.append((head[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), chr(head[at + 11]), head[at + 16], head[at + 17]))
    return Fields(begin, size, found, encoding)


def rings_of(raw: bytes) -> list[list[dict[str, float]]] | None:
    """The parts of one record's geometry."""
    (kind,) = struct.unpack_from("<i", raw)
    if kind in EMPTY:
        return None
    if kind in POINTS:
        x, y = struct.unpack_from("<dd", raw, 4)
        return [[{"x": x, "y": y}]]
    if kind in SETS:
        (n,) = struct.unpack_from("<i", raw, 36)
        starts, at = [0], 40
    elif kind in LINES:
        parts, n = struct.unpack_from("<ii", raw, 36)
        starts, at = struct.unpack_from(f"<{parts}i", raw, 44), 44 + 4 * parts
    else:
        raise LayoutError(f"shapes of type {kind} are not read")
    points = [{"x": x, "y": y} for x, y in np.frombuffer(raw, "<f8", 2 * n, at).reshape(-1, 2).tolist()]
    return [points[a:b] for a, b in zip(starts, [*starts[1:], n], strict=True)]


def _stem(path: str) -> str:
    return path[:-4]


def _encoding(stem: str) -> str:
    for ending in (".cpg", ".CPG"):
        if (got := opened(stem + ending)) is not None:
            named = got(0, 64).decode("ascii", "ignore").strip()
            return ENCODINGS.get(named, named) or "latin-1"
    return "latin-1"


def _part(path: str, ending: str):
    """A reader of the file beside a .shp file, whichever case its ending has."""
    for e in (ending, ending.upper()):
        if (got := opened(_stem(path) + e)) is not None:
            return got
    raise LayoutError(f"{path} lacks its {ending} file")


@dataclass
class Records(datasource.InputPartition):
    path: str
    first: int
    last: int


def index_size(index) -> int:
    """The number of records, from the index file's length."""
    head = index(0, 100)
    if len(head) < 100 or struct.unpack(">i", head[:4])[0] != 9994:
        raise LayoutError("not the index of a shapefile")
    return (struct.unpack(">i", head[24:28])[0] * 2 - 100) // 8


def rows_of(shapes, index, table, fields: Fields, first: int, last: int) -> Iterator[tuple]:
    """(record, properties, rings) of a range of records."""
    if last <= first:
        return
    places = np.frombuffer(index(100 + 8 * first, 8 * (last - first)), ">i4").reshape(-1, 2).astype(np.int64) * 2
    low, high = int(places[:, 0].min()), int((places[:, 0] + 8 + places[:, 1]).max())
    raw = shapes(low, high - low)
    attributes = table(fields.begin + first * fields.size, (last - first) * fields.size)
    for i, (at, size) in enumerate(places.tolist()):
        properties = fields.row(attributes[i * fields.size : (i + 1) * fields.size])
        if properties is not None:
            yield first + i, properties, rings_of(raw[at - low + 8 : at - low + 8 + size])


class ShapeReader(datasource.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.records = options["path"], int(options.get("records", RECORDS))
        self.encoding = options.get("encoding")

    def _paths(self) -> list[str]:
        found = [f for f in listed(self.path) if f.lower().endswith(".shp")]
        if not found:
            raise LayoutError(f"{self.path} holds no shapefile")
        return found

    def partitions(self) -> list[Records]:
        return [Records(p, k, min(n, k + self.records)) for p in self._paths() for n in [index_size(_part(p, ".shx"))] for k in range(0, n, self.records)] or [Records("", 0, 0)]

    def read(self, partition: Records) -> Iterator[tuple]:
        if not partition.path:
            return
        table = _part(partition.path, ".dbf")
        fields = fields_of(table, self.encoding or _encoding(_stem(partition.path)))
        shapes = opened(partition.path)
        for record, properties, rings in rows_of(shapes, _part(partition.path, ".shx"), table, fields, partition.first, partition.last):
            yield record, properties, rings and [[(p["x"], p["y"]) for p in ring] for ring in rings]


class ShapeSource(datasource.DataSource):
    """Options: `path` (a .shp file, a folder, or a pattern of names), `records` of a task, and `encoding` of the attributes,
    which is otherwise that of the .cpg file, or Latin-1."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShapeReader:
        if "path" not in self.options:
            raise ValueError("the option path is needed")
        return ShapeReader(dict(self.options))


def read(spark: SparkSession, path: str, records: int = RECORDS) -> DataFrame:
    """(record, properties, rings) of a shapefile, or of all in a folder."""
    if not reachable(path):
        raise LayoutError(f"{path} cannot be listed")
    spark.dataSource.register(ShapeSource)
    return spark.read.format("shapefile").options(path=path, records=records).load()


def attributes(path: str) -> list[str]:
    """The names of a shapefile's attributes, from the header of its table."""
    stem = path if path.lower().endswith(".shp") else next(f for f in listed(path) if f.lower().endswith(".shp"))
    return [name for name, _, _, _ in fields_of(_part(stem, ".dbf"), _encoding(_stem(stem))).fields]
