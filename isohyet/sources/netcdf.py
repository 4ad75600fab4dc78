"""NetCDF files, classic (versions 1 and 2) and NetCDF-4, as a long table, and grids as classic files.

`NetcdfSource` is a Spark data source, `spark.read.format("netcdf_grid")` once `register` has been called: its partitions
are slabs of times, made from the headers, and bounds of time, lat and lon leave only the slabs, rows and chunks that
hold what is asked for to be read. Bounds are options of a load. `NetcdfPushedSource`, `netcdf_grid_pushed`, takes the
filters of a query too; as Spark 4.1 keeps what one query has pushed with the loaded DataFrame, each query must load its
own. Where Arrow doesn't know a file system, `read` takes whole files from Spark's own
reader. Each file gives rows (file, time, lat, lon, value) of one variable. Coordinates have synonyms; dimensions of size
1 are dropped, others refused; the calendars `360`, `360_day` and `standard` are decoded, and times are snapped to day 1.
Grids are written one file a time, by the task that has it.
"""

from __future__ import annotations

import datetime
import struct
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, datasource
from pyspark.sql import functions as F

from isohyet.sources.files import listed as _files
from isohyet.sources.files import opened as _opened
from isohyet.sources.files import reachable as _reachable
from isohyet.sources.hdf5 import SIGNATURE, Hdf5, ranged
from isohyet.sources.tables import COORDINATES, LayoutError

#: Types of the format, and the tags of its lists.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
MISSING = ("_FillValue", "missing_value")
SLAB_BYTES = 32 << 20
HEAD_BYTES = 1 << 16  # of a file that are read for its header at first; coordinates may lie anywhere
PLANNED_FILES = 10_000  # whose headers the driver reads to plan slabs
SCHEMA = "file string, time date, lat double, lon double, value double"
ROWS = [("file", pa.string()), ("time", pa.date32()), ("lat", pa.float64()), ("lon", pa.float64()), ("value", pa.float64())]


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 4
        if raw[:3] != b"CDF" or raw[3] not in (1, 2):
            raise LayoutError("not a classic NetCDF file")
        self.wide = raw[3] == 2

    def number(self, kind: str = ">i") -> int:
        (v,) = struct.unpack_from(kind, self.raw, self.at)
        self.at += struct.calcsize(kind)
        return v

    def name(self) -> str:
        n = self.number()
        text = self.raw[self.at : self.at + n].decode()
        self.at += -(-n // 4) * 4
        return text

    def values(self):
        kind, n = self.number(), self.number()
        dtype = np.dtype(TYPES[kind])
        found = np.frombuffer(self.raw, dtype, n, self.at)
        self.at += -(-n * dtype.itemsize // 4) * 4
        return found.tobytes().decode("utf-8", "replace").rstrip("\0") if kind == 2 else found

    def listed(self, tag: int, one) -> list:
        found, n = self.number(), self.number()
        if found not in (0, tag):
            raise LayoutError("a list of the header has the wrong tag")
        return [one() for _ in range(n)]


class Header:
    """Names, shapes and places of a classic file's variables: name -> (dimensions, shape, attributes, dtype)."""

    def __init__(self, raw: bytes, read: Callable[[int, int], bytes] | None = None):
        r = _Reader(raw)
        self.file = read or (lambda at, n: raw[at : at + n])
        self.records = max(0, r.number())
        dims = r.listed(DIMENSION, lambda: (r.name(), r.number()))
        attribute = lambda: (r.name(), r.values())
        r.listed(ATTRIBUTE, attribute)

        def variable():
            name, ids = r.name(), [r.number() for _ in range(r.number())]
            attrs = dict(r.listed(ATTRIBUTE, attribute))
            kind, size = r.number(), r.number()
            return name, ids, attrs, np.dtype(TYPES[kind]), size, r.number(">q" if r.wide else ">i")

        found = r.listed(VARIABLE, variable)
        growing = {i for i, (_, n) in enumerate(dims) if n == 0}
        self.step = sum(v[4] for v in found if v[1] and v[1][0] in growing)
        self.variables, self._places = {}, {}
        for name, ids, attrs, dtype, _, begin in found:
            shape = [self.records if i in growing else dims[i][1] for i in ids]
            self.variables[name] = ([dims[i][0] for i in ids], shape, attrs, dtype)
            self._places[name] = begin, self.step if ids and ids[0] in growing else None

    def values(self, name: str, box: list[tuple[int, int]] | None = None) -> np.ndarray:
        """A variable's values, or those of a range of each dimension."""
        _, shape, _, dtype = self.variables[name]
        begin, step = self._places[name]
        return ranged(self.file, begin, dtype, shape, [(0, n) for n in shape] if box is None else box, step)


def header(read: Callable[[int, int], bytes]) -> Header | Hdf5:
    """What a file holds; read(place, size) gives bytes of it. The header takes as many bytes as it has."""
    if read(0, 8) == SIGNATURE:
        return Hdf5(read)
    size = HEAD_BYTES
    while True:
        raw = read(0, size)
        try:
            return Header(raw, read)
        except (struct.error, ValueError, IndexError) as e:
            if isinstance(e, LayoutError) or len(raw) < size:
                raise
            size *= 4


def parse(raw: bytes) -> dict[str, tuple[list[str], np.ndarray, dict]]:
    """name -> (dimensions, values, attributes) of all variables."""
    h = header(lambda at, n: raw[at : at + n])
    return {name: (v[0], h.values(name), v[2]) for name, v in h.variables.items()}


def decode_time(values: np.ndarray, units: str, calendar: str = "standard") -> list[datetime.date | None]:
    """First days of months, from months or days since a date; days that a calendar does not have give None."""
    unit, _, since = units.partition(" since ")
    base = datetime.date.fromisoformat("-".join(f"{int(x):0{4 if i == 0 else 2}d}" for i, x in enumerate(since.split()[0].split("-"))))
    out: list[datetime.date | None] = []
    for v in np.asarray(values, float):
        if unit.startswith("month"):
            m = base.year * 12 + base.month - 1 + int(np.floor(v))
            out.append(datetime.date(m // 12, m % 12 + 1, 1))
        elif calendar in ("360", "360_day"):
            d = base.year * 360 + (base.month - 1) * 30 + base.day - 1 + int(np.floor(v))
            try:
                out.append(datetime.date(d // 360, d % 360 // 30 + 1, d % 30 + 1).replace(day=1))
            except ValueError:
                out.append(None)
        else:
            out.append((base + datetime.timedelta(days=int(np.floor(v)))).replace(day=1))
    return out


@dataclass
class Grid:
    """How a variable lies over its axes."""

    head: Header | Hdf5
    variable: str
    named: list[str]  # of each dimension, the axis that it is to us
    axes: dict[str, str]  # of each axis, its name in the file
    bytes_a_time: int
    together: int  # times that lie in one chunk

    def times(self) -> list[datetime.date | None]:
        of_time = self.head.variables[self.axes["time"]][2]
        return decode_time(self.head.values(self.axes["time"]), _text(of_time.get("units", "")), _text(of_time.get("calendar", "standard")))

    def axis(self, name: str) -> np.ndarray:
        return self.head.values(self.axes[name]).astype(float)


def _text(value) -> str:
    return value if isinstance(value, str) else str(np.ravel(value)[0]) if np.size(value) else ""


def grid_of(head: Header | Hdf5, variable: str) -> Grid:
    if variable not in head.variables:
        raise LayoutError(f"the file has no variable {variable}")
    own = {other: name for name, others in COORDINATES.items() for other in others}
    dims, shape, _, dtype = head.variables[variable]
    named = [own.get(d, d) for d in dims]
    if any(n != 1 for d, n in zip(named, shape, strict=True) if d not in COORDINATES) or {"time", "lat", "lon"} - set(named):
        raise LayoutError("the variable needs time, lat and lon, and other dimensions of size 1 only")
    times = shape[named.index("time")]
    axes = {x: d for d, x in zip(dims, named, strict=True) if x in COORDINATES}
    chunk = head.sets[variable].chunk if isinstance(head, Hdf5) else []
    together = max(1, chunk[named.index("time")]) if chunk else 1
    return Grid(head, variable, named, axes, int(np.prod(shape, dtype=int)) // max(1, times) * dtype.itemsize, together)


def slab(grid: Grid, first: int = 0, last: int | None = None, asked: Asked | None = None) -> pd.DataFrame:
    """Rows (time, lat, lon, value) of a range of times of one variable, as far as they are asked for."""
    asked = asked or Asked()
    lat, lon, times = grid.axis("lat"), grid.axis("lon"), grid.times()
    last = len(times) if last is None else min(len(times), last)
    span = {"time": (first, last), "lat": _span(asked.of("lat", lat)), "lon": _span(asked.of("lon", lon))}
    data = grid.head.values(grid.variable, [span.get(d, (0, 1)) for d in grid.named])
    attrs = grid.head.variables[grid.variable][2]
    data = np.squeeze(data, tuple(i for i, d in enumerate(grid.named) if d not in COORDINATES)).astype(float)
    kept = [d for d in grid.named if d in COORDINATES]
    data = np.transpose(data, [kept.index(y) for y in ("time", "lat", "lon")])
    for name in MISSING:
        if name in attrs:
            data[np.isclose(data, float(np.ravel(attrs[name])[0]))] = np.nan
    times, lat, lon = times[first:last], lat[slice(*span["lat"])], lon[slice(*span["lon"])]
    t, y, x = (a.ravel() for a in np.meshgrid(np.arange(len(times)), lat, lon, indexing="ij"))
    frame = pd.DataFrame({"time": np.array(times, object)[t] if len(times) else [], "lat": y, "lon": x, "value": data.ravel()})
    wanted = asked.of("time", times)[t] & asked.of("lat", y) & asked.of("lon", x) if len(t) else np.zeros(0, bool)
    frame = frame[frame["time"].notna() & wanted]
    return frame.assign(value=lambda f: f["value"].where(f["value"].notna(), None))


def _span(mask: np.ndarray) -> tuple[int, int]:
    at = np.flatnonzero(mask)
    return (int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0)


def grid_rows(raw: bytes, variable: str) -> pd.DataFrame:
    """Rows (time, lat, lon, value) of one variable of a file."""
    return slab(grid_of(header(lambda at, n: raw[at : at + n]), variable))


#: Filters that are pushed down, as comparisons of an axis' values.
COMPARED: dict[type, Callable] = {
    datasource.EqualTo: lambda x, v: x == v,
    datasource.GreaterThan: lambda x, v: x > v,
    datasource.GreaterThanOrEqual: lambda x, v: x >= v,
    datasource.LessThan: lambda x, v: x < v,
    datasource.LessThanOrEqual: lambda x, v: x <= v,
    datasource.In: lambda x, v: x in v,
}


#: Options that bound an axis, both ends included.
BOUNDS = {
    "from": ("time", datasource.GreaterThanOrEqual),
    "to": ("time", datasource.LessThanOrEqual),
    "south": ("lat", datasource.GreaterThanOrEqual),
    "north": ("lat", datasource.LessThanOrEqual),
    "west": ("lon", datasource.GreaterThanOrEqual),
    "east": ("lon", datasource.LessThanOrEqual),
}


class Asked:
    """Filters on the axes, all of which must hold."""

    def __init__(self, options: dict | None = None) -> None:
        self.filters: list[tuple[str, type, object]] = []
        for name, (axis, kind) in BOUNDS.items():
            if name in (options or {}):
                self.filters.append((axis, kind, datetime.date.fromisoformat(options[name]) if axis == "time" else float(options[name])))

    def take(self, f: datasource.Filter) -> bool:
        """Whether a filter is answered here."""
        if type(f) is datasource.IsNotNull:
            return f.attribute in (("file",), ("time",), ("lat",), ("lon",))  # which never are
        name = getattr(f, "attribute", ())
        if type(f) not in COMPARED or name not in (("time",), ("lat",), ("lon",)):
            return False
        self.filters.append((name[0], type(f), f.value))
        return True

    def of(self, axis: str, values: Sequence) -> np.ndarray:
        """Which values of an axis are asked for."""
        own = [(COMPARED[kind], value) for name, kind, value in self.filters if name == axis]
        return np.array([v is not None and all(holds(v, value) for holds, value in own) for v in values], bool)


@dataclass
class Slab(datasource.InputPartition):
    path: str
    first: int
    last: int  # -1: the task makes the slabs of a whole file itself


def _slabs(path: str, variable: str, slab_bytes: int, asked: Asked) -> list[Slab]:
    """Runs of the times that are asked for, cut into slabs; none if no place of the file is asked for."""
    got = _opened(path)
    if got is None:
        raise LayoutError(f"{path} cannot be opened")
    grid = grid_of(header(got), variable)
    if not asked.of("lat", grid.axis("lat")).any() or not asked.of("lon", grid.axis("lon")).any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], asked.of("time", grid.times()).view(np.int8), [0]])))
    # Slabs end where chunks do, so that a chunk is unpacked by one task.
    most = max(1, slab_bytes // max(1, grid.bytes_a_time) // grid.together) * grid.together
    return [Slab(path, max(int(a), k), min(int(b), k + most)) for a, b in zip(edges[::2], edges[1::2], strict=True) for k in range(int(a) // most * most, int(b), most)]


class GridReader(datasource.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.variable = options["path"], options["variable"]
        self.slab_bytes = int(options.get("slabbytes", SLAB_BYTES))
        self.asked = Asked(options)

    def partitions(self) -> list[Slab]:
        """Slabs of all files; of very many files, a partition a file, whose header its task reads."""
        files = _files(self.path)
        if len(files) > PLANNED_FILES:
            return [Slab(f, 0, -1) for f in files]
        with ThreadPoolExecutor(16) as pool:
            found = pool.map(lambda f: _slabs(f, self.variable, self.slab_bytes, self.asked), files)
        return [s for own in found for s in own] or [Slab("", 0, 0)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        slabs = _slabs(partition.path, self.variable, self.slab_bytes, self.asked) if partition.last < 0 else [partition] if partition.path else []
        for s in slabs:
            rows = slab(grid_of(header(_opened(s.path)), self.variable), s.first, s.last, self.asked)
            yield pa.RecordBatch.from_pandas(rows.assign(file=s.path)[["file", "time", "lat", "lon", "value"]], pa.schema(ROWS), preserve_index=False)


class PushedGridReader(GridReader):
    def pushFilters(self, filters: list[datasource.Filter]) -> Iterator[datasource.Filter]:
        return (f for f in filters if not self.asked.take(f))


class NetcdfSource(datasource.DataSource):
    """Options: `path` (a file, a folder, or a pattern of names), `variable`, `slabBytes` of a task, and bounds: `from` and
    `to` as dates, `south`, `north`, `west` and `east`."""

    Reader: type[GridReader] = GridReader

    @classmethod
    def name(cls) -> str:
        return "netcdf_grid"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GridReader:
        missing = [o for o in ("path", "variable") if o not in self.options]
        if missing:
            raise ValueError(f"the option {missing[0]} is needed")
        return self.Reader(dict(self.options))


class NetcdfPushedSource(NetcdfSource):
    """The same, with the filters of the query that reads it. A loaded DataFrame serves one query."""

    Reader = PushedGridReader

    @classmethod
    def name(cls) -> str:
        return "netcdf_grid_pushed"


def register(spark: SparkSession, pushed: bool = False) -> None:
    """Make the format netcdf_grid known to a session, and if asked netcdf_grid_pushed, which needs a setting."""
    spark.dataSource.register(NetcdfSource)
    if pushed:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(NetcdfPushedSource)


def read(spark: SparkSession, path: str, variable: str, slab_bytes: int = SLAB_BYTES, **bounds: str | float) -> DataFrame:
    """(file, time, lat, lon, value) of files of either kind, by slabs where Arrow reaches them, else by whole files. Bounds
    are those of the data source: from_, to, south, north, west, east."""
    options = {name.rstrip("_"): str(v) for name, v in bounds.items()}
    if odd := set(options) - set(BOUNDS):
        raise ValueError(f"unknown bounds: {', '.join(sorted(odd))}")
    if _reachable(path):
        register(spark)
        return spark.read.format("netcdf_grid").options(path=path, variable=variable, slabBytes=slab_bytes, **options).load()

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, raw in zip(f["path"], f["content"], strict=True):
                grid = grid_of(header(lambda at, n, raw=raw: raw[at : at + n]), variable)
                yield slab(grid, asked=Asked(options)).assign(file=name)[["file", "time", "lat", "lon", "value"]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(whole, SCHEMA)


def _first_header(spark: SparkSession, path: str) -> dict[str, tuple]:
    """name -> (dimensions, shape, attributes, dtype) of the first file's variables, from its header alone where Arrow
    reaches it."""
    if _reachable(path):
        return header(_opened(_files(path)[0])).variables
    first = spark.read.format("binaryFile").load(path).limit(1).select("content").first()
    return header(lambda at, n: first["content"][at : at + n]).variables if first else {}


def units(spark: SparkSession, path: str, variable: str, default: str = "mm") -> str:
    """The units of a variable of the first file; those of rainfall where it names none."""
    own = _first_header(spark, path).get(variable)
    return (own and _text(own[2].get("units", ""))) or default


def read_observed(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """(loc_id, time, latitude, longitude, value, units) of observations to verify against: negative values are missing,
    places are named by their coordinates, which are those of EPSG:4326."""
    rows = read(spark, path, variable)
    name = F.format_string("%.6f_%.6f", "lat", "lon").alias("loc_id")
    value = F.when(F.col("value") >= 0, F.col("value")).alias("value")
    return rows.select(name, "time", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), value, F.lit(units(spark, path, variable)).alias("units"))


def variables(spark: SparkSession, path: str) -> list[str]:
    """The names of a file's variables that are no coordinates."""
    known = {x for others in COORDINATES.values() for x in others}
    return [v for v in _first_header(spark, path) if v not in known]


def encode(times: list[float], units: str, lat: np.ndarray, lon: np.ndarray, layers: dict[str, tuple[np.ndarray, dict]], calendar: str = "standard", names: tuple[str, str, str] = ("time", "lat", "lon")) -> bytes:
    """A classic file of variables over time, lat and lon: doubles, or bytes where the data are; NaN is the fill value."""
    codes = {np.dtype(t): k for k, t in TYPES.items()}

    def text(s: str) -> bytes:
        b = s.encode()
        return struct.pack(">i", len(b)) + b + b"\0" * (-len(b) % 4)

    def attrs(items: dict) -> bytes:
        if not items:
            return struct.pack(">ii", 0, 0)
        value = lambda v: struct.pack(">i", 2) + text(v) if isinstance(v, str) else struct.pack(">iid", 6, 1, v)
        return struct.pack(">ii", ATTRIBUTE, len(items)) + b"".join(text(k) + value(v) for k, v in items.items())

    of_axis = [{"units": units, "calendar": calendar, "axis": "T", "standard_name": "time"}, {"units": "degrees_north", "axis": "Y", "standard_name": "latitude"}, {"units": "degrees_east", "axis": "X", "standard_name": "longitude"}]
    parts = [(name, [i], a, np.asarray(v, ">f8")) for i, (name, v, a) in enumerate(zip(names, (times, lat, lon), of_axis, strict=True))]
    for name, (data, own) in layers.items():
        data = np.asarray(data)
        small = data.dtype == np.int8
        parts.append((name, [0, 1, 2], own if small else {"_FillValue": float("nan")} | own, data if small else data.astype(">f8")))
    head = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", DIMENSION, 3) + b"".join(text(n) + struct.pack(">i", len(v)) for n, _, _, v in parts[:3]) + attrs({}) + struct.pack(">ii", VARIABLE, len(parts))
    size = lambda v: -(-v.nbytes // 4) * 4
    fixed = [text(n) + struct.pack(">i", len(i)) + struct.pack(f">{len(i)}i", *i) + attrs(a) + struct.pack(">ii", codes[v.dtype], size(v)) for n, i, a, v in parts]
    begin = len(head) + sum(len(f) + 4 for f in fixed)
    body = b""
    for f, (_, _, _, v) in zip(fixed, parts, strict=True):
        head += f + struct.pack(">i", begin + len(body))
        body += v.tobytes() + b"\0" * (size(v) - v.nbytes)
    return head + body


def write_bytes(times: list[float], units: str, lat: np.ndarray, lon: np.ndarray, name: str, data: np.ndarray, calendar: str = "standard") -> bytes:
    """A classic file of one variable over time, lat and lon."""
    return encode(times, units, lat, lon, {name: (data, {})}, calendar)


def write(df: DataFrame, folder: str, overwrite: bool = True) -> DataFrame:
    """Write a grid (time, lat, lon, and columns of numbers) as one file a time; returns (path, cells).

    A time's grid must fit into a task. Files get a name of their own and are then renamed, so a repeated task does no
    harm. Where overwrite is off, a time whose file is there is left as it is."""
    columns = [c for c, t in df.dtypes if c not in ("time", "lat", "lon") and t in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    kinds = dict(df.dtypes)
    folder = folder if "://" in folder else f"file://{folder}"

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(folder)
        path = f"{at}/{key[0]:%Y%m}.nc"
        if overwrite or system.get_file_info(path).type == fs.FileType.NotFound:
            lat, lon = np.unique(f["lat"]), np.unique(f["lon"])
            layers = {}
            for c in columns:
                small = kinds[c] == "tinyint"
                data = np.zeros((1, len(lat), len(lon)), np.int8) if small else np.full((1, len(lat), len(lon)), np.nan)
                data[0, np.searchsorted(lat, f["lat"]), np.searchsorted(lon, f["lon"])] = f[c].fillna(0).astype(np.int8) if small else f[c].astype(float)
                layers[c] = (data, {})
            system.create_dir(at, recursive=True)
            own = f"{path}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(own) as out:
                out.write(encode([0], f"months since {key[0]:%Y-%m-%d}", lat, lon, layers))
            system.move(own, path)
        return pd.DataFrame({"path": [f"{folder}/{key[0]:%Y%m}.nc"], "cells": [len(f)]})

    done = df.select("time", "lat", "lon", *columns).groupBy("time").applyInPandas(one, "path string, cells long")
    return df.sparkSession.createDataFrame(done.collect(), "path string, cells long")  # a row a time
