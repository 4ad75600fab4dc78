"""NetCDF as a data source: pushed filters, bytes read, NetCDF-4."""

import datetime

import numpy as np
import pytest
from pyspark.sql import datasource
from pyspark.sql import functions as F

from isohyet.sources import netcdf, tables
from tests.hdf5_files import netcdf4

LAT, LON = np.arange(40) * 0.5 - 10, np.arange(50) * 0.5 + 20
DATA = np.random.default_rng(1).normal(size=(60, 40, 50))
UNITS = "months since 2000-01-01"


def variables(chunk, dtype="<f4"):
    data = DATA.astype(dtype)
    data[12:24, 20:] = np.nan
    return {
        "time": (["time"], np.arange(60, dtype="<i4"), {"units": UNITS, "calendar": "360_day"}, None),
        "lat": (["lat"], LAT.astype("<f8"), {"units": "degrees_north"}, None),
        "lon": (["lon"], LON.astype(">f8"), {"units": "degrees_east"}, None),
        "pr": (["time", "lat", "lon"], data, {"units": "mm/month", "_FillValue": np.array([-99.0], dtype)}, chunk),
    }


@pytest.fixture(scope="module")
def classic(tmp_path_factory):
    path = tmp_path_factory.mktemp("nc") / "a.nc"
    path.write_bytes(netcdf.write_bytes(list(range(60)), UNITS, LAT, LON, "pr", DATA))
    return str(path)


@pytest.fixture(scope="module")
def chunked(tmp_path_factory):
    path = tmp_path_factory.mktemp("nc4") / "b.nc"
    path.write_bytes(netcdf4(variables((7, 16, 50)), ["time", "lat", "lon"]))
    return str(path)


def bytes_read(monkeypatch, path, *filters):
    """Rows and bytes that a scan takes once its slabs are planned."""
    taken = [0]
    opened = netcdf._opened

    def counting(name):
        got = opened(name)

        def read(at, n):
            raw = got(at, n)
            taken[0] += len(raw)
            return raw

        return read

    with monkeypatch.context() as m:
        m.setattr(netcdf, "_opened", counting)
        reader = netcdf.PushedGridReader({"path": path, "variable": "pr", "slabbytes": "100000"})
        assert list(reader.pushFilters(list(filters))) == []
        parts = reader.partitions()
        rows = sum(b.num_rows for p in parts for b in reader.read(p))
    return rows, taken[0], len(parts)


@pytest.mark.parametrize("kind", ["classic", "chunked"])
def test_filters_leave_bytes_unread(request, monkeypatch, kind):
    path = request.getfixturevalue(kind)
    month = datasource.EqualTo(("time",), datetime.date(2003, 5, 1))
    box = [datasource.GreaterThanOrEqual(("lat",), -2.0), datasource.LessThan(("lat",), 2.0)]
    rows, every, parts = bytes_read(monkeypatch, path)
    assert rows == DATA.size and parts >= 4
    one, few, single = bytes_read(monkeypatch, path, month)
    assert one == 2000 and single == 1 and few < every / 3
    assert bytes_read(monkeypatch, path, month, *box)[:2] < (8 * 50 + 1, few)
    assert bytes_read(monkeypatch, path, datasource.GreaterThan(("lon",), 1000.0))[0] == 0


def test_a_months_bytes_are_those_of_the_month(monkeypatch, tmp_path):
    """What a one-month scan reads beyond header and axes is the month's slab, whatever the file's length."""
    took = []
    for n in (10, 1000):
        path = tmp_path / f"{n}.nc"
        path.write_bytes(netcdf.write_bytes(list(range(n)), UNITS, LAT, LON, "pr", np.zeros((n, 40, 50))))
        took.append(bytes_read(monkeypatch, str(path), datasource.EqualTo(("time",), datetime.date(2000, 5, 1)))[1])
    assert took[1] - took[0] <= 8 * 1000 * 4 + 2 * netcdf.HEAD_BYTES and took[1] < 1000 * 40 * 50 * 8 / 50


@pytest.mark.parametrize("kind", ["classic", "chunked"])
def test_source_equals_filtered_rows(spark, request, kind):
    path = request.getfixturevalue(kind)
    data = np.array(variables(None)["pr"][1], float) if kind == "chunked" else DATA
    netcdf.register(spark, pushed=True)
    load = lambda: spark.read.format("netcdf_grid_pushed").option("path", path).option("variable", "pr").load()
    narrowed = lambda df: df.filter((F.col("time") >= "2001-06-01") & (F.col("time") < "2002-03-01") & F.col("lat").between(-3, 3) & F.col("lon").isin(25.0, 30.5))
    asked, whole = narrowed(load()), netcdf.read(spark, path, "pr")
    assert "PushedFilters: []" not in asked._jdf.queryExecution().toString()
    got = {(r["time"], r["lat"], r["lon"]): r["value"] for r in asked.collect()}
    expected = {}
    for t in range(17, 26):
        for y in np.flatnonzero((LAT >= -3) & (LAT <= 3)):
            for x in (10, 21):
                v = data[t, y, x]
                expected[datetime.date(2000 + t // 12, t % 12 + 1, 1), LAT[y], LON[x]] = None if np.isnan(v) else v
    assert got == expected
    assert narrowed(load()).filter("value > 0").count() == sum(v is not None and v > 0 for v in expected.values())
    # Bounds are of the load, and filters on it are Spark's: one DataFrame may serve many queries.
    bounded = netcdf.read(spark, path, "pr", from_="2001-06-01", to="2002-02-01", south=-3, north=3)
    assert {(r["time"], r["lat"], r["lon"]): r["value"] for r in bounded.filter(F.col("lon").isin(25.0, 30.5)).collect()} == expected
    assert bounded.count() == 9 * 13 * 50 and narrowed(whole).count() == len(expected)
    assert whole.agg(F.count("value")).first()[0] == np.isfinite(data).sum()


@pytest.mark.parametrize("links", [False, True])
@pytest.mark.parametrize("chunk,filters,dtype", [((7, 16, 50), [2, 1], "<f4"), ((60, 1, 50), [1], ">f4"), ((5, 40, 7), [], "<f8"), (None, None, "<f4"), ((1, 8, 8), [2, 1], "<f8")])
def test_chunks_give_the_array_back(chunk, filters, dtype, links):
    own = variables(chunk, dtype)
    raw = netcdf4(own, ["time", "lat", "lon"], links=links, filters=filters)
    found = netcdf.parse(raw)
    for name, (dims, data, attrs, _) in own.items():
        assert found[name][0] == dims
        assert found[name][1].dtype == data.dtype and found[name][1].tobytes() == data.tobytes() or np.array_equal(found[name][1], data, equal_nan=True)
        assert {k: v for k, v in found[name][2].items() if isinstance(v, str)} == {k: v for k, v in attrs.items() if isinstance(v, str)}
    h = netcdf.header(lambda at, n: raw[at : at + n])
    for box in ([(3, 4), (0, 40), (0, 50)], [(0, 60), (17, 18), (49, 50)], [(6, 9), (15, 33), (2, 30)], [(59, 60), (39, 40), (0, 1)], [(5, 5), (0, 40), (0, 50)]):
        assert np.array_equal(h.values("pr", box), own["pr"][1][tuple(slice(*b) for b in box)], equal_nan=True)


def test_a_slab_takes_its_chunks_only():
    raw = netcdf4(variables((1, 40, 50)), ["time", "lat", "lon"], fan_out=4)
    taken = []

    def read(at, n):
        taken.append((at, min(n, len(raw) - at)))
        return raw[at : at + n]

    h = netcdf.header(read)
    taken.clear()
    h.values("pr", [(30, 31), (0, 40), (0, 50)])
    assert sum(n for _, n in taken) < len(raw) / 10 and len(taken) < 25


def test_what_is_not_read_is_named(spark, tmp_path):
    own = variables((7, 16, 50))
    with pytest.raises(tables.LayoutError, match="fletcher32"):
        netcdf.parse(netcdf4(own, ["time", "lat", "lon"], filters=[3]))
    with pytest.raises(tables.LayoutError, match="superblock of version 9"):
        netcdf.parse(b"\x89HDF\r\n\x1a\n\x09" + bytes(100))
    with pytest.raises(tables.LayoutError, match="no variable tas"):
        netcdf.grid_rows(netcdf4(own, ["time", "lat", "lon"]), "tas")
    with pytest.raises(Exception, match="option variable is needed"):
        netcdf.register(spark)
        spark.read.format("netcdf_grid").option("path", str(tmp_path)).load().count()


def test_folders_patterns_and_headers(spark, tmp_path, chunked):
    for k in range(3):
        (tmp_path / f"p{k}.nc").write_bytes(netcdf.write_bytes([k], UNITS, LAT[:2], LON[:3], "pr", DATA[k : k + 1, :2, :3]))
    assert netcdf.read(spark, str(tmp_path), "pr").count() == 18
    assert netcdf.read(spark, str(tmp_path / "p[01].nc"), "pr").select("time").distinct().count() == 2
    assert netcdf.read(spark, f"file://{tmp_path}", "pr").select("file").distinct().count() == 3
    assert netcdf.units(spark, chunked, "pr") == "mm/month" and netcdf.variables(spark, chunked) == ["pr"]
    assert tables.variables(spark, chunked) == ["pr"]


def test_header_of_a_long_file_is_read_alone(spark, tmp_path):
    """A file of over 2 GB (sparse on disk): its header and one slab are read, never the whole."""
    head = netcdf.write_bytes([0.0], UNITS, LAT[:1], LON[:1], "pr", np.zeros((1, 1, 1)))
    path = tmp_path / "long.nc"
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(3 << 30)
    assert netcdf.units(spark, str(path), "pr") == "mm" and netcdf.variables(spark, str(path)) == ["pr"]
    assert netcdf.read(spark, str(path), "pr").count() == 1
