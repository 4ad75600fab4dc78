"""Shapefiles against the same GeoJSON."""

import json
import struct

import pytest

from isohyet.sources import shapefile, tables

SQUARE = lambda x, y, s: [[x, y], [x, y + s], [x + s, y + s], [x + s, y], [x, y]]
HOLE = lambda x, y, s: SQUARE(x, y, s)[::-1]
ZONES = [
    ({"NAME": "Plain", "CODE": 7, "AREA": 12.5, "WET": True}, [[SQUARE(0, 0, 4)]]),
    ({"NAME": "Ringed", "CODE": -3, "AREA": 0.25, "WET": False}, [[SQUARE(10, 0, 6), HOLE(12, 2, 2)]]),
    ({"NAME": "İki parça", "CODE": 12345, "AREA": 100.0, "WET": None}, [[SQUARE(20, 0, 3)], [SQUARE(30, 0, 5), HOLE(31, 1, 1), HOLE(33, 3, 1)]]),
]


def write(folder, zones, kind=5, deleted=(), cpg="UTF-8"):
    fields = [("NAME", "C", 20, 0), ("CODE", "N", 9, 0), ("AREA", "N", 12, 3), ("WET", "L", 1, 0)]
    body, index = b"", b""
    for i, (_, polygons) in enumerate(zones):
        rings = [r for p in polygons or [] for r in p]
        points = [xy for r in rings for xy in r]
        if polygons is None:
            content = struct.pack("<i", 0)
        elif kind in (1, 11):
            content = struct.pack("<idd", kind, *points[0])
        else:
            starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
            box = [min(x for x, _ in points), min(y for _, y in points), max(x for x, _ in points), max(y for _, y in points)]
            content = struct.pack("<i4dii", kind, *box, len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<dd", *p) for p in points)
            content += struct.pack(f"<2d{len(points)}d", 0, 0, *([1.5] * len(points))) if kind == 15 else b""
        index += struct.pack(">ii", (100 + len(body)) // 2, len(content) // 2)
        body += struct.pack(">ii", i + 1, len(content) // 2) + content
    head = lambda n: struct.pack(">i20xi", 9994, (100 + n) // 2) + struct.pack("<ii64x", 1000, kind)
    (folder / "zones.shp").write_bytes(head(len(body)) + body)
    (folder / "zones.shx").write_bytes(head(len(index)) + index)
    size = 1 + sum(w for _, _, w, _ in fields)
    table = struct.pack("<B3BIHH20x", 3, 124, 1, 1, len(zones), 32 + 32 * len(fields) + 1, size)
    table += b"".join(struct.pack("<11sc4xBB14x", n.encode(), k.encode(), w, d) for n, k, w, d in fields) + b"\r"
    for i, (own, _) in enumerate(zones):
        row = b"*" if i in deleted else b" "
        for n, k, w, d in fields:
            v = own[n]
            text = "" if v is None else v.ljust(w) if k == "C" else ("T" if v else "F") if k == "L" else f"{v:{w}.{d}f}"
            raw = text.encode("utf-8")
            row += raw[:w] + b" " * (w - len(raw)) if k == "C" else (text if v is not None else "?" * w if k == "L" else " " * w).encode()
        table += row
    (folder / "zones.dbf").write_bytes(table + b"\x1a")
    if cpg:
        (folder / "zones.cpg").write_text(cpg)
    return str(folder / "zones.shp")


def geojson(folder, zones):
    shape = lambda p: {"type": "Polygon", "coordinates": p[0]} if len(p) == 1 else {"type": "MultiPolygon", "coordinates": p}
    path = folder / "zones.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": own, "geometry": shape(p)} for own, p in zones]}))
    return str(path)


def as_set(df):
    plain = lambda rings: None if rings is None else tuple(tuple((p["x"], p["y"]) for p in r) for r in rings)
    return {(tuple(sorted(r["properties"].items(), key=str)), plain(r["rings"])) for r in df.collect()}


@pytest.mark.parametrize("kind", [5, 15])
@pytest.mark.parametrize("records", [1, 2, 100])
def test_equals_the_same_geojson(spark, tmp_path, kind, records):
    found = shapefile.read(spark, write(tmp_path, ZONES, kind), records)
    assert as_set(found.select("properties", "rings")) == as_set(tables.read_geojson(spark, geojson(tmp_path, ZONES)))
    assert found.rdd.getNumPartitions() == -(-len(ZONES) // records)


def test_rows_and_names(spark, tmp_path):
    path = write(tmp_path, [*ZONES, ({"NAME": "", "CODE": None, "AREA": None, "WET": None}, None)], deleted=(1,))
    rows = {r["record"]: r for r in shapefile.read(spark, path).collect()}
    assert set(rows) == {0, 2, 3} and rows[3]["rings"] is None
    assert rows[3]["properties"] == {"NAME": "", "CODE": None, "AREA": None, "WET": None}
    assert tables.variables(spark, path) == ["NAME", "CODE", "AREA", "WET"]
    assert tables.read_map(spark, path).count() == 3 and shapefile.read(spark, str(tmp_path)).count() == 3


def test_points_and_refusals(spark, tmp_path):
    points = [(own, [[[[3.0, 4.0 + i]]]]) for i, (own, _) in enumerate(ZONES)]
    assert [r["rings"][0][0]["y"] for r in shapefile.read(spark, write(tmp_path, points, kind=1)).orderBy("record").collect()] == [4.0, 5.0, 6.0]
    with pytest.raises(tables.LayoutError, match="type 31"):
        shapefile.rings_of(struct.pack("<i", 31))
    (tmp_path / "zones.dbf").unlink()
    with pytest.raises(Exception, match="lacks its .dbf"):
        shapefile.read(spark, str(tmp_path / "zones.shp")).collect()


def test_an_empty_shapefile(spark, tmp_path):
    assert shapefile.read(spark, write(tmp_path, [])).count() == 0


def test_records_of_a_task_are_read_alone(tmp_path):
    path = write(tmp_path, ZONES * 200)
    taken = []

    def counting(name):
        got = shapefile.opened(name)

        def read(at, n):
            raw = got(at, n)
            taken.append(len(raw))
            return raw

        return read

    table = counting(path[:-4] + ".dbf")
    fields = shapefile.fields_of(table, "utf-8")
    taken.clear()
    assert len(list(shapefile.rows_of(counting(path), counting(path[:-4] + ".shx"), table, fields, 300, 306))) == 6
    assert sum(taken) < 6 * 600
