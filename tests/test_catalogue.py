"""Every registered query with an oracle against DuckDB; the others must give rows."""

import math
from pathlib import Path

import duckdb
import pytest

from isohyet.plans import catalogue

SLOW = {"forest_hindcast", "mlp_hindcast", "kmeans_zones", "zoning_pipeline"}  # tested below


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_oracle(spark, con, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    ran = con.execute(catalogue.ORACLES[name])
    want = rows_of([d[0] for d in ran.description], ran.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) > 0 or name in ("drop_incomplete_locations", "zoning_season_matrix", "small_polygon_clean", "zoning_data")
    different = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not different, different[:3]
    kinds = {d[0]: str(d[1]) for d in ran.description}
    for column, kind in df.dtypes:
        family = {"bigint": "NUMBER", "double": "NUMBER", "string": "STRING", "boolean": "bool"}.get(kind, kind)
        assert kind in ("bigint", "double", "string", "boolean"), (column, kind, family, kinds[column])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - SLOW))
def test_gives_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_zoning_pipeline_gives_zones(spark, sf_dir):
    got = catalogue.QUERIES["zoning_pipeline"](spark, sf_dir.replace("sf0.001", "sf0.01")).collect()
    assert len(got) == 81 and len({(r["row_idx"], r["col_idx"]) for r in got}) == 81 and {r["zone"] for r in got} == set(range(1, max(r["zone"] for r in got) + 1))


@pytest.mark.parametrize("name", ["forest_hindcast", "mlp_hindcast", "kmeans_zones"])
def test_slow_models_give_rows(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    value = "zone" if "zone" in df.columns else "h"
    assert df.filter(f"{value} is not null").count() > 0
