"""Ties, thresholds, edges and properties of the outlook operators."""

import datetime
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.functions import calendar as cal
from isohyet.functions import categories as cat
from isohyet.functions import skill
from isohyet.functions import text as txt
from isohyet.operators import align, clean, models, probability, season, spatial, synthesis
from isohyet.sources import netcdf, tables


def one(spark, **columns):
    return list(spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first())


def lit(*values):
    return [F.lit(v) for v in values]


def test_threshold_rules(spark):
    t, i, q = cat.tercile, cat.tercile_inclusive, lit(1.0, 2.0)
    assert one(spark, a=t(F.lit(2.0), *q), b=t(F.lit(1.0), *q), c=t(F.lit(2.1), *q)) == [2, 1, 3]
    assert one(spark, a=i(F.lit(2.0), *q), b=i(F.lit(1.0), *q), c=i(F.lit(1.5), *q), d=i(F.lit(1.0), *lit(1.0, 1.0))) == ["above", "below", "normal", "below"]
    assert one(spark, a=cat.quartile_category(F.lit(1.5), *lit(1.0, 1.5, 2.0)), b=t(F.lit(None).cast("double"), *q)) == [2, None]


@pytest.mark.parametrize(("p", "tercile", "category", "klass"), [((0.2, 0.4, 0.4), "above", "normal-to-above", 1), ((1 / 3, 1 / 3, 1 / 3), "above", "below", 0), ((0.25, 0.5, 0.25), "normal", "normal-to-below", 1), ((0.4, 0.4, 0.2), "normal", "below", 0)])
def test_tie_rules(spark, p, tercile, category, klass):
    assert one(spark, a=cat.likeliest_tercile(*lit(*p)), b=cat.likeliest_category(*lit(*p)), c=cat.likeliest_class(*lit(*p))) == [tercile, category, klass]


def test_cell_scores(spark):
    hit = skill.heidke_hit(*lit(0.4, 0.4, 0.2), F.lit(1))
    got = one(spark, a=hit, b=skill.interest_rate(F.lit(0.4)), c=skill.ignorance_of_cell(F.lit(0.0)), d=skill.rpss_of_cell(F.lit(1), F.lit(1)), e=skill.category_hit(F.lit(1), F.lit(4)), f=skill.category_hit(F.lit(1), F.lit(3)))
    assert got == pytest.approx([0.5, 21.2121212, 6.6438562, 0.2515, 0, 1], abs=1e-4)
    for f, o in itertools.product(range(1, 5), repeat=2):
        assert one(spark, a=skill.category_hit(F.lit(f), F.lit(o)), b=skill.category_hit(F.lit(o), F.lit(f)))[0] == 3 - abs(f - o)


def test_calendar(spark):
    table = {c: (n, m) for c, n, m in cal.season_table()}
    assert len(table) == 36 and table["DJF"] == (3, 2) and table["DJ"] == (2, 1) and table["JF"] == (2, 2) and table["Dec"] == (1, 12)
    ends = [cal.season_end_year(F.lit(2022), *lit(*table[c])) for c in ("DJF", "NDJ", "DJ", "JFM")]
    assert one(spark, a=ends[0], b=ends[1], c=ends[2], d=ends[3]) == [2023, 2023, 2023, 2022]
    leads = [cal.lead_months(*lit(s, t)) for s, t in ((7, 12), (12, 1), (1, 12))]
    assert one(spark, a=leads[0], b=leads[1], c=leads[2], d=cal.lead_is_valid(leads[2])) == [5, 1, 11, False]
    y, m, d = cal.days_since_360(2001, F.lit(59))
    assert one(spark, y=y, m=m, d=d, date=cal.date_of_360(y, m, d)) == [2001, 2, 30, None]
    assert one(spark, a=cal.month_of_index(F.lit(2001 * 12 + 12)), b=cal.month_number(F.lit("Foo"))) == [datetime.date(2001, 12, 1), None]


def test_text(spark):
    got = one(spark, a=txt.fix_name(F.lit(" A-b (c) ")), b=txt.sanitize(F.lit(". a//b?:c. ")), c=txt.size_label(F.lit(1536.0)), d=txt.duration_label(F.lit(90061)), e=txt.is_number(F.lit("1e3")), f=txt.is_number(F.lit("x")), g=txt.fold_accents(F.lit("Été")))
    assert got == ["A_b_c", "a_b_c", "1.5KiB", "1 hour(s) 1 minute(s) 1 second(s)", True, False, "Ete"]


def series(spark, values, start=datetime.date(2000, 1, 1)):
    rows = []
    for i, v in enumerate(values):
        n = start.year * 12 + start.month - 1 + i
        rows.append(("a", datetime.date(n // 12, n % 12 + 1, 1), v))
    return spark.createDataFrame(rows, "loc_id string, time date, value double")


def test_resample_edges(spark):
    months = series(spark, [1.0] * 14)
    got = {r["time"].isoformat(): r["value"] for r in season.resample(months, 12).collect()}
    assert got == {"1999-12-01": 2.0, "2000-12-01": 3.0}
    assert [r["value"] for r in season.resample(months, 12, complete_only=True).collect()] == [3.0]
    gaps = series(spark, [None] * 14)
    assert {r["value"] for r in season.resample(gaps, 12).collect()} == {0.0} and season.resample(gaps, 12, "mean").count() == 0


def test_rolling_needs_all_months(spark):
    df = series(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0])
    assert {r["time"].month: r["value"] for r in season.rolling(df, 3).collect()} == {6: 15.0}


def test_cleaning(spark):
    rows = [("a", 1.0)] * 3 + [("a", float(i)) for i in range(2, 9)] + [("b", 1.0)] * 2 + [("b", float(i)) for i in range(2, 10)]
    df = spark.createDataFrame(rows, "loc_id string, value double")
    assert {r["loc_id"] for r in clean.varied_locations(df).collect()} == {"b"}
    gappy = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0)], "loc_id string, value double")
    assert [r["loc_id"] for r in clean.complete_locations(gappy).collect()] == ["b"]
    assert one(spark, a=clean.not_nan(F.lit(float("nan"))), b=clean.not_negative(F.lit(-1.0)), c=clean.without_sentinel(F.lit(-999.0), -999)) == [None, None, None]


def hindcast(spark, n=12, seed=1):
    rng = np.random.default_rng(seed)
    rows = [("a", datetime.date(2000 + i, 1, 1), float(rng.normal()), float(rng.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "loc_id string, time date, y double, h double"), rows


def test_folds_and_out_of_fold_lines(spark):
    df = spark.createDataFrame([("a", datetime.date(2000 + i, 1, 1), float(i % 7), float(i * i % 11)) for i in range(37)], "loc_id string, time date, x double, y double")
    folded = align.with_folds(df)
    assert sorted(r["count"] for r in folded.groupBy("fold").count().collect()) == [7, 7, 7, 8, 8]
    rows = folded.orderBy("time").collect()
    got = {r["time"]: r["h"] for r in align.out_of_fold_ols(folded).collect()}
    for r in rows:
        other = [(o["x"], o["y"]) for o in rows if o["fold"] != r["fold"]]
        s, i = np.polyfit(*zip(*other, strict=True), 1)
        assert got[r["time"]] == pytest.approx(i + s * r["x"])


def test_closed_forms(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=30)
    y = 2 * x + rng.normal(size=30)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y, strict=True)], "loc_id string, x double, y double")
    f = align.standard_fit(df, ridge=1.0, lasso=0.1).first()
    z = (x - x.mean()) / x.std()
    yc = y - y.mean()
    assert f["w_ols"] == pytest.approx(z @ yc / 30) and f["w_ridge"] == pytest.approx(z @ yc / 31)
    grid = np.linspace(-4, 4, 80001)
    best = grid[np.argmin([((yc - w * z) ** 2).mean() / 2 + 0.1 * abs(w) for w in grid])]
    assert f["w_lasso"] == pytest.approx(best, abs=2e-4)


def test_probabilities_and_scores(spark):
    df, rows = hindcast(spark)
    limits = spark.createDataFrame([("a", -0.4, 0.4)], "loc_id string, q33 double, q66 double")
    p = probability.probabilities(df, limits)
    errors = np.array([h - y for _, _, y, h in rows])
    for r in p.collect():
        h = next(x[3] for x in rows if x[1] == r["time"])
        assert r["p_above"] == pytest.approx((errors + h > 0.4).mean()) and r["p_below"] + r["p_normal"] + r["p_above"] == pytest.approx(1)
    scores = {r["score"]: r["value"] for r in probability.skill_table(df, p).collect()}
    assert len(scores) == 12
    assert scores["2afc"] == pytest.approx(np.mean([scores[f"ROC_{c}"] for c in ("above", "normal", "below")]))
    assert scores["correlation"] == pytest.approx(np.corrcoef([r[2] for r in rows], [r[3] for r in rows])[0, 1])
    rows_p = p.collect()
    for k, c in enumerate(probability.CLASSES):
        event = [r[f"p_{c}"] for r in rows_p if r["obs_class"] == k]
        rest = [r[f"p_{c}"] for r in rows_p if r["obs_class"] != k]
        want = np.mean([(a > b) + 0.5 * (a == b) for a in event for b in rest])
        assert probability.roc(p).first()[f"roc_{c}"] == pytest.approx(want)
    third = p.withColumns({f"p_{c}": F.lit(1.0) / 3 for c in probability.CLASSES})
    assert probability.rpss(third).first()["rpss"] == pytest.approx(0)


def test_spatial(spark):
    square = spark.createDataFrame([("s", [[{"x": 0.0, "y": 0.0}, {"x": 20.0, "y": 0.0}, {"x": 20.0, "y": 20.0}, {"x": 0.0, "y": 20.0}]]), ("t", [[{"x": 10.0, "y": -5.0}, {"x": 40.0, "y": -5.0}, {"x": 25.0, "y": 30.0}]])], "zone_id string, rings array<array<struct<x: double, y: double>>>")
    edges = spatial.edges_of_rings(square)
    assert edges.count() == 7
    points = spark.createDataFrame([("in", 5.0, 5.0), ("both", 5.0, 18.0), ("out", 50.0, 5.0), ("null", None, None)], "loc_id string, lat double, lon double")
    assert sorted((r["loc_id"], r["zone_id"]) for r in spatial.within(points, edges).collect()) == [("both", "s"), ("both", "t"), ("in", "s")]
    stations = spark.createDataFrame([("a", 0.0, 0.0, 1.0), ("b", 0.0, 2.0, 3.0)], "loc_id string, lat double, lon double, value double")
    grid = spatial.mesh(spark, 0, 2, 0, 0, 1)
    assert [r["value"] for r in spatial.idw(grid, stations, ["col_idx"]).orderBy("col_idx").collect()] == pytest.approx([1, 2, 3])
    assert [r["value"] for r in models.rbf(grid, stations, ["col_idx"]).orderBy("col_idx").collect()] == pytest.approx([1, 2, 3])
    stats = {r["zone_id"]: (r["count"], r["mean"]) for r in spatial.zonal_stats(points.select("loc_id", F.lit(2.0).alias("value")), spatial.within(points, edges), edges.select("zone_id").union(spark.createDataFrame([("u",)], "z string"))).collect()}
    assert stats == {"s": (2, 2.0), "t": (1, 2.0), "u": (0, None)}


def test_models():
    assert models.component_limit(6, [0.5, 1.0]) == 0 and models.component_limit(20, [0.3, 0.6, 0.8, 0.9, 0.99]) == 3
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    y = 2 * x[:, 0] + 0.1 * rng.normal(size=40)
    assert models.principal(x)[1].sum() == pytest.approx(1)
    for name, predict in models.REGRESSORS.items():
        error = np.mean((predict(x[:30], y[:30], x[30:]) - y[30:]) ** 2)
        assert error < np.var(y[30:]), name
    assert models.ridge_predict(x[:30], y[:30], x[30:], 0.0) == pytest.approx(models.ols_predict(x[:30], y[:30], x[30:]))
    assert models.lasso_predict(x[:30], y[:30], x[30:], 0.0) == pytest.approx(models.ols_predict(x[:30], y[:30], x[30:]))
    assert np.ptp(models.lasso_predict(x[:30], y[:30], x[30:], 50.0)) == 0
    assert models.elbow([(1, 100.0), (2, 20.0), (3, 15.0), (4, 10.0)]) == 2


def test_synthesis(spark):
    assert one(spark, a=synthesis.confidence(*lit("all high", "high")), b=synthesis.confidence(*lit("", "low")), c=synthesis.category_code(F.lit("normal to above"))) == ["very high", "", 3]
    d = spark.createDataFrame([("z", "high", "all low", "below normal"), ("y", "", "all low", "below normal")], "zone string, signalAgree string, skillLevel string, fcstCategory string")
    assert [r["zone"] for r in synthesis.is_complete(d).collect()] == ["y"]
    p = {r["zone"]: r["properties"] for r in synthesis.properties(d, "Zone", 2022, "MAM").collect()}["z"]
    assert p == {"Zone": "z", "finalcode_2022-MAM": "1", "finalcategory_2022-MAM": "below normal", "finalconfidence": "moderate", "agreement_2022-MAM": "high", "skill_2022-MAM": "all low"}


def test_station_files(spark, tmp_path):
    head = "ID,Lat,Lon,Year," + ",".join(cal.MONTHS)
    (tmp_path / "m.csv").write_text(head + "\n" + "\n".join(f"s1,-1.5,30,{y}," + ",".join(str(m if m != 3 else -999) for m in range(12)) for y in (2000, 2001)))
    got = tables.read_stations(spark, str(tmp_path / "m.csv"), sentinel=-999)
    assert got.count() == 24 and got.filter("value is null").count() == 2 and got.agg(F.sum("value")).first()[0] == 2 * (66 - 3)
    (tmp_path / "c.csv").write_text("ID,s1,s2\nLat,-1,-2\nLon,30,31\n2000-01-31,1,2\n2000-02-29,3,-5\n")
    got = sorted((r["loc_id"], r["time"].isoformat(), r["value"]) for r in tables.read_stations(spark, str(tmp_path / "c.csv")).collect() if r["value"] is not None)
    assert got == [("s1", "2000-01-01", 1.0), ("s1", "2000-02-01", 3.0), ("s2", "2000-01-01", 2.0)]
    (tmp_path / "bad.csv").write_text(head.replace("ID", "Name") + "\n")
    with pytest.raises(tables.LayoutError):
        tables.read_stations(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "i.txt").write_text("year header\n2000 1.0 99.90 3 4 5 6 7 8 9 10 11 12\n")
    assert tables.read_index_text(spark, str(tmp_path / "i.txt")).count() == 11
    (tmp_path / "i.csv").write_text("date,NINO\n2000-01-31,0.5\n")
    assert list(tables.read_index(spark, str(tmp_path / "i.csv")).first()) == [datetime.date(2000, 1, 1), 0.5]


def test_geojson(spark, tmp_path):
    text = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"Zone":1},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}}]}'
    (tmp_path / "z.geojson").write_text(text)
    row = tables.read_geojson(spark, str(tmp_path / "z.geojson")).first()
    assert row["properties"] == {"Zone": "1"} and len(row["rings"]) == 2 and row["rings"][1][2]["x"] == 6.0


def test_geojson_is_written_and_read(spark, tmp_path):
    rows = [({"Zone": str(i)}, f'{{"type":"Polygon","coordinates":[[[{i},0],[{i + 1},0],[{i + 1},1],[{i},0]]]}}') for i in range(3)]
    features = spark.createDataFrame(rows, "properties map<string,string>, geometry string")
    for single in (False, True):
        tables.write_geojson(features, str(tmp_path / str(single)), single)
        got = tables.read_geojson(spark, str(tmp_path / str(single)), lines=not single).collect()
        assert sorted((r["properties"]["Zone"], r["rings"][0][1]["x"]) for r in got) == [("0", 1.0), ("1", 2.0), ("2", 3.0)]
    with pytest.raises(ValueError):
        tables.feature_collection(features, most=2)


def test_observed_grids_and_products(spark, tmp_path):
    from isohyet.sources.requests import GridRequest

    data = np.array([[[1.0, -5.0]]])
    for name, attrs in (("a", {}), ("b", {"units": "cm"})):
        (tmp_path / f"{name}.nc").write_bytes(netcdf.encode([0], "months since 2000-01-01", [0.5], [30.0, 31.0], {"pr": (data, attrs)}, names=("T", "Y", "X")))
    got = {r["loc_id"]: (r["value"], r["units"]) for r in netcdf.read_observed(spark, str(tmp_path / "a.nc"), "pr").collect()}
    assert got == {"0.500000_30.000000": (1.0, "mm"), "0.500000_31.000000": (None, "mm")}
    assert netcdf.units(spark, str(tmp_path / "b.nc"), "pr") == "cm"
    assert GridRequest.of_product("GPH500_NCEP-NCAR_IRIDL", 1900, 2000).level == 500.0 and GridRequest.of_product("SST_CCSM4_IRIDL", 1900, 2000, lead=2).source_first_year == 1981
    for code, options in (("SST_CCSM4_IRIDL", {}), ("SST_ERSSTv5_IRIDL", {"lead": 1}), ("x", {})):
        with pytest.raises(ValueError):
            GridRequest.of_product(code, 1990, 2000, **options)


def test_netcdf(spark, tmp_path):
    data = np.arange(12.0).reshape(3, 2, 2)
    (tmp_path / "a.nc").write_bytes(netcdf.write_bytes([0, 1, 2], "months since 2000-11-01", np.array([-1.0, 1.0]), np.array([30.0, 31.0]), "pr", data))
    rows = netcdf.read(spark, str(tmp_path / "a.nc"), "pr").collect()
    assert len(rows) == 12 and {r["time"].isoformat() for r in rows} == {"2000-11-01", "2000-12-01", "2001-01-01"}
    assert next(r["value"] for r in rows if r["time"].year == 2001 and r["lat"] == 1.0 and r["lon"] == 31.0) == 11.0
    assert netcdf.decode_time(np.array([59.0]), "days since 2001-01-01", "360_day") == [None]


def test_netcdf_by_slabs_and_back(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(30, 4, 5))
    data[3, 1, 2] = np.nan
    lat, lon = np.arange(4) * 0.25 - 1, np.arange(5) * 0.5 + 30
    (tmp_path / "big.nc").write_bytes(netcdf.write_bytes(list(range(30)), "months since 1999-01-01", lat, lon, "pr", data))
    whole = netcdf.read(spark, str(tmp_path / "big.nc"), "pr")
    cut = netcdf.read(spark, str(tmp_path / "big.nc"), "pr", slab_bytes=500)
    assert cut.rdd.getNumPartitions() >= 10 > whole.rdd.getNumPartitions()
    key = lambda d: sorted(map(str, map(tuple, d.select("time", "lat", "lon", "value").collect())))
    assert key(whole) == key(cut) and cut.count() == data.size and cut.filter("value is null").count() == 1
    grid = cut.filter("month(time) = 2").select("time", "lat", "lon", "value", F.lit(7).cast("byte").alias("zone"))
    files = netcdf.write(grid, str(tmp_path / "out")).collect()
    assert len(files) == 3 and {r["cells"] for r in files} == {20} and netcdf.variables(spark, files[0]["path"]) == ["value", "zone"]
    assert key(netcdf.read(spark, str(tmp_path / "out"), "value")) == key(grid)
    assert {r["value"] for r in netcdf.read(spark, str(tmp_path / "out"), "zone").collect()} == {7.0}
    assert netcdf.read(spark, str(tmp_path / "out"), "value").filter("value is null").count() == grid.filter("value is null").count()
    with pytest.raises(tables.LayoutError):
        netcdf.grid_rows((tmp_path / "big.nc").read_bytes(), "none")


def test_output_kinds(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5, 2), ("b", None, 3)], "loc_id string, value double, n int")
    tables.write_output(rows, str(tmp_path / "c"), "csv")
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "c"), header=True, schema=rows.schema).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    tables.write_output(rows.limit(0), str(tmp_path / "c"), "csv", overwrite=False)
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    with pytest.raises(ValueError):
        tables.write_output(rows, str(tmp_path / "d"), "xls")
    points = spark.createDataFrame([("a", 1.0, 10.0), ("b", 2.0, 20.0)], "loc_id string, lat double, lon double")
    layers = rows.select("loc_id", F.lit("z").alias("zone_id"), F.lit(datetime.date(2001, 3, 1)).alias("time"), F.col("value").alias("obs_value"), F.col("n").alias("fcst_cemcat"))
    path = tables.write_verification(layers, points, str(tmp_path), "JFM", "2001", "obs")
    got = spark.read.csv(path, header=True, inferSchema=True)
    assert got.columns == ["loc_id", "zone_id", "obs_value", "fcst_cemcat", "lat", "lon"] and got.count() == 2
    path = tables.write_verification(layers, points, str(tmp_path / "nc"), "JFM", "2001", "obs", kind="netcdf")
    assert sorted((r["lat"], r["value"]) for r in netcdf.read(spark, path, "fcst_cemcat").filter("value is not null").collect()) == [(1.0, 2.0), (2.0, 3.0)]
    assert tables.variables(spark, str(tmp_path / "pr_chirps.csv")) == ["pr"]


def test_merged_station_files(spark, tmp_path):
    head = "ID,Lat,Lon,Year," + ",".join(cal.MONTHS)
    line = lambda name, year, cells: f"{name},40,30,{year}," + ",".join(cells)
    one = [line("Iğdır Şehir", 2000, ["1"] * 11 + ["-999"]), line("Iğdır Şehir", 2001, ["-999.0"] * 6 + ["-999"] * 6)]
    two = [line("İzmir-1", 2000, [str(i) for i in range(12)]), line("İzmir-1", 2000, ["x"] + [str(i + 1) for i in range(11)])]
    for name, lines in (("one", one), ("two", two)):
        (tmp_path / f"{name}.csv").write_bytes("\n".join([head, *lines]).encode("iso-8859-9"))
    paths = [str(tmp_path / f"{n}.csv") for n in ("one", "two")]
    raw = spark.read.csv(paths, header=True, encoding="ISO-8859-1")
    letters = raw.select(F.translate("ID", tables.LATIN_1, tables.LATIN_5).alias("ID"))
    assert {r["ID"] for r in letters.collect()} == {"Iğdır Şehir", "İzmir-1"}
    got = tables.read_stations_union(spark, paths, -999)
    assert sorted((r["ID"], r["Year"], r["Dec"]) for r in got.collect() if r["Jan"] != "x") == [("I_d_r_ehir", "2000", None), ("zmir_1", "2000", "11")]
    series = tables.station_series(got)
    assert series.count() == 24 and series.filter("value is null").count() == 2 and {r["lat"] for r in series.collect()} == {40.0}


def test_mid_season_labels(spark):
    from isohyet.sources.requests import from_mid_season

    df = spark.createDataFrame([(datetime.date(2000, 1, 16), 1.0)], "time date, value double")
    assert tuple(from_mid_season(df).first()) == (datetime.date(1999, 12, 1), 1.0, datetime.date(2000, 2, 1))
    assert tuple(from_mid_season(df, seasonal=False).first()) == (datetime.date(2000, 1, 1), 1.0, datetime.date(2000, 1, 1))


def test_interpolation_by_blocks_and_sizes(spark):
    rng = np.random.default_rng(3)
    stations = spark.createDataFrame([(f"s{i}", float(rng.integers(0, 9)), float(rng.integers(0, 9)), float(rng.normal())) for i in range(60)], "loc_id string, lat double, lon double, value double")
    grid = spatial.mesh(spark, 0, 9, 0, 9, 0.75)
    one, many = (sorted((r["row_idx"], r["col_idx"], round(r["value"], 9)) for r in spatial.idw(grid, stations, ["row_idx", "col_idx"], most=n).collect()) for n in (1000, 7))
    assert one == many and len(one) == 169
    at = stations.dropDuplicates(["lat", "lon"]).select("loc_id", "lat", "lon", "value")
    back = {r["loc_id"]: r["value"] for r in models.rbf(at.select("loc_id", "lat", "lon"), at, ["loc_id"]).collect()}
    assert all(back[r["loc_id"]] == pytest.approx(r["value"], abs=1e-8) for r in at.collect())
    boxes_ = [(1, "a", 0, 0, 10, 10), (2, "a", 1, 1, 2, 2), (3, "a", 20, 20, 21, 21), (4, "b", 3, 3, 5, 5), (5, "a", 0, 0, 10, 10)]
    df = spark.createDataFrame([(str(i), z, *map(float, x)) for i, z, *x in boxes_], "poly_id string, zone string, min_x double, min_y double, max_x double, max_y double")
    corners = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y"))))
    outlines = spatial.edges_of_rings(df.withColumn("rings", F.array(corners)), "poly_id")
    assert [r["poly_id"] for r in spatial.small_polygons(df, outlines).collect()] == ["2"]


def test_points_within_a_polygon_of_many_tiles(spark):
    rng = np.random.default_rng(6)
    ring = [(50 + 45 * np.cos(a) * (1 + 0.3 * np.sin(5 * a)), 50 + 45 * np.sin(a) * (1 + 0.3 * np.sin(5 * a))) for a in np.linspace(0, 2 * np.pi, 90, endpoint=False)]
    edges = spatial.edges_of_rings(spark.createDataFrame([("z", [[{"x": float(x), "y": float(y)} for x, y in ring]])], "zone_id string, rings array<array<struct<x: double, y: double>>>"))
    points = [(str(i), float(y), float(x)) for i, (x, y) in enumerate(rng.uniform(-10, 110, (400, 2)))]

    def inside(y, x):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    got = {r["loc_id"] for r in spatial.within(spark.createDataFrame(points, "loc_id string, lat double, lon double"), edges).collect()}
    assert got == {n for n, y, x in points if inside(y, x)} and 100 < len(got) < 300


def test_principal_components_of_rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + 5
    df = spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>").repartition(5)
    got = models.gram_pca(df).orderBy("k").collect()
    assert [r["variance_ratio"] for r in got] == pytest.approx(models.principal(x)[1].tolist())
    assert models.total_inertia(df) == pytest.approx(((x - x.mean(0)) ** 2).sum())
    costs = models.kmeans_costs(df, 3)
    assert [k for k, _ in costs] == [1, 2, 3] and costs[0][1] > costs[1][1] > costs[2][1]
    assert models.kmeans_costs(spark.createDataFrame([([1.0],)] * 4, "features array<double>")) == [(1, 0.0)]
    assert models.gram_pca(df.limit(0)).count() == 0


def test_config(tmp_path):
    assert tables.load_config(str(tmp_path / "none.json"), {"a": 1}) == {"a": 1}
    tables.save_config(str(tmp_path / "c.json"), {"b": 2})
    assert tables.load_config(str(tmp_path / "c.json"), {"a": 1}) == {"a": 1, "b": 2}
