"""Workflows end to end on small made-up series."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.operators import align, fields, models
from isohyet.plans import workflows as wf
from isohyet.sources import netcdf, tables
from tests.test_shared import plain_tree, walk
from isohyet.sources.requests import GridRequest, fetch, relabelled


def monthly(spark, locations=("a", "b"), years=range(1980, 2006), seed=0):
    rng = np.random.default_rng(seed)
    rows = [(loc, datetime.date(y, m, 1), float(rng.gamma(2, 20))) for loc in locations for y in years for m in range(1, 13)]
    return spark.createDataFrame(rows, "loc_id string, time date, value double")


@pytest.mark.parametrize(("regressor", "shared"), [("ols", False), ("ridge", True), ("lasso", False)])
def test_forecast_tables(spark, regressor, shared):
    obs, pred = monthly(spark), monthly(spark, seed=1)
    if shared:
        pred = pred.filter("loc_id = 'a'").drop("loc_id")
    spec = wf.ForecastSpec(source_month=9, target="Dec-Feb", climatology=(1985, 2000), forecast_year=2005, regressor=regressor)
    out = wf.forecast(spec, obs.filter("time < '2005-12-01'"), pred)
    assert set(out) == {"deterministic-fcst", "probabilistic-fcst", "skill", "deterministic-hcst", "probabilistic-hcst"}
    assert out["skill"].count() == 24 and out["deterministic-fcst"].count() == 2
    p = out["probabilistic-fcst"].select((F.col("p_below") + F.col("p_normal") + F.col("p_above")).alias("s"), "category").collect()
    assert [r["s"] for r in p] == pytest.approx([1, 1]) and all(r["category"] for r in p)
    assert out["deterministic-hcst"].count() == out["probabilistic-hcst"].count() == 2 * 25


def field_of(spark, cells, times, seed, shared=None):
    rng = np.random.default_rng(seed)
    signal = rng.normal(size=(len(times), 2)) if shared is None else shared
    x = signal @ rng.normal(size=(2, cells)) + 0.4 * rng.normal(size=(len(times), cells)) + 10
    rows = [(f"c{j}", t, float(x[i, j])) for i, t in enumerate(times) for j in range(cells)]
    return spark.createDataFrame(rows, "loc_id string, time date, value double").repartition(3), x, signal


def september_and_december(spark, years=30, cells=9, locations=4):
    """A predictor field in September with one year more, and a predictand in December with the same signal."""
    times = [datetime.date(1975 + i, 9, 1) for i in range(years + 1)]
    pred, x, signal = field_of(spark, cells, times, 1)
    obs, y, _ = field_of(spark, locations, [datetime.date(t.year, 12, 1) for t in times[:-1]], 2, signal[:-1])
    return obs, pred, x, y


SPEC = dict(source_month=9, target="Dec", climatology=(1976, 2000), forecast_year=2005)


def by_cell(df, column="h"):
    out = {}
    for r in df.collect():
        out.setdefault(r["loc_id"], {})[r["time"].year] = r[column]
    return np.array([[v for _, v in sorted(out[f"c{j}"].items())] for j in range(len(out))]).T


def scaled_by(x, fit):
    deviation = x[fit].std(0)
    return (x - x[fit].mean(0)) / np.where(deviation == 0, 1, deviation)


def test_pcr_equals_numpy(spark):
    obs, pred, x, y = september_and_december(spark)
    n = len(y)
    for regressor, predict in (("pcr", models.ols_predict), ("ridge", lambda a, b, c: models.ridge_predict(a, b, c, 2.0)), ("lasso", lambda a, b, c: models.lasso_predict(a, b, c, 0.3)), ("tree", None)):
        spec = wf.ForecastSpec(**SPEC, regressor=regressor, preprocessor="pcr", alpha={"ridge": 2.0, "lasso": 0.3}.get(regressor))
        hcst, fcst, estimate = wf.fitted_models(spec, obs, pred)

        def scores(fit):
            z = scaled_by(x, fit)
            _, s, v = np.linalg.svd(z[fit], full_matrices=False)
            k = models.component_limit(len(fit), (s**2 / (s**2).sum()).cumsum().tolist())
            v = v * np.sign((z[fit] @ v.T)[np.abs(z[fit] @ v.T).argmax(0), np.arange(len(v))])[:, None]
            return z @ v[:k].T

        def predicted(f, fit, rows, predict=predict):
            if predict:
                return np.column_stack([predict(f[fit], y[fit, j], f[rows]) for j in range(y.shape[1])])
            tree = plain_tree(f[fit], y[fit], 2)  # one for all locations
            return np.array([walk(tree, r) for r in f[rows]])

        want = np.zeros_like(y)
        for out in np.array_split(np.arange(n), 5):
            fit = np.setdiff1d(np.arange(n), out)
            want[out] = predicted(scores(fit), fit, out)
        whole = scores(np.arange(n))
        assert by_cell(hcst) == pytest.approx(want, abs=1e-6) and by_cell(hcst, "y") == pytest.approx(y)
        full = predicted(whole, np.arange(n), np.arange(n + 1))
        assert by_cell(fcst) == pytest.approx(full[n:], abs=1e-6) and by_cell(estimate) == pytest.approx(full[:n], abs=1e-6)


def test_cca_equals_numpy(spark):
    obs, pred, x, y = september_and_december(spark)
    n = len(y)
    hcst, fcst, estimate = wf.fitted_models(wf.ForecastSpec(**SPEC, regressor="cca"), obs, pred)

    def predicted(fit):
        parts, zs = [], []
        for m in (x, y):
            fit_rows = scaled_by(m, fit)
            u, s, v = np.linalg.svd(fit_rows[fit], full_matrices=False)
            k = int(np.argmax((s**2 / (s**2).sum()).cumsum() >= 0.95)) + 1
            parts.append((u[:, :k], s[:k], v[:k]))
            zs.append(fit_rows)
        (ux, sx, vx), (uy, sy, vy) = parts
        a, _, b = np.linalg.svd(ux.T @ uy, full_matrices=False)
        k = max(1, min(len(sx), len(sy), int(0.15 * len(fit))))
        tx, ty = (zs[0] @ vx.T / sx) @ a[:, :k], uy @ b[:k].T
        back = np.column_stack([models.ols_predict(tx[fit], ty[:, j], tx) for j in range(k)]) @ b[:k] * sy @ vy
        return back * y[fit].std(0) + y[fit].mean(0)

    want = np.zeros_like(y)
    for out in np.array_split(np.arange(n), 5):
        want[out] = predicted(np.setdiff1d(np.arange(n), out))[out]
    assert by_cell(hcst) == pytest.approx(want, abs=1e-6)
    full = predicted(np.arange(n))
    assert by_cell(fcst) == pytest.approx(full[n:], abs=1e-6) and by_cell(estimate) == pytest.approx(full[:n], abs=1e-6)


@pytest.mark.parametrize(("preprocessor", "regressor"), [("none", "pcr"), ("none", "cca"), ("none", "tree"), ("none", "forest"), ("none", "mlp"), ("pcr", "forest"), ("pcr", "mlp"), ("cca", "tree")])
def test_forecast_of_every_model(spark, preprocessor, regressor):
    obs, pred, _, y = september_and_december(spark)
    out = wf.forecast(wf.ForecastSpec(**SPEC, regressor=regressor, preprocessor=preprocessor), obs, pred)
    assert set(out) == {"deterministic-fcst", "probabilistic-fcst", "skill", "deterministic-hcst", "probabilistic-hcst"}
    assert out["deterministic-fcst"].filter("value is not null").count() == out["probabilistic-fcst"].count() == 4
    assert out["deterministic-hcst"].count() == out["probabilistic-hcst"].count() == y.size
    if preprocessor != "none" or regressor in ("pcr", "cca"):
        assert out["skill"].filter("score = 'correlation'").agg(F.min("value")).first()[0] > 0.3


def test_models_leave_one_out_and_refusals(spark):
    obs, pred, _, y = september_and_december(spark, years=12)
    hcst = wf.fitted_models(wf.ForecastSpec(**SPEC | {"forecast_year": 1987}, regressor="pcr", leave_one_out=True), obs, pred)[0]
    assert hcst.count() == y.size
    for bad in (dict(regressor="svm"), dict(preprocessor="ica")):
        with pytest.raises(ValueError):
            wf.ForecastSpec(**SPEC | bad).validate()
    few = wf.ForecastSpec(**SPEC | {"forecast_year": 1980}, regressor="pcr")
    with pytest.raises(ValueError):
        wf.fitted_models(few, obs.filter("year(time) < 1980"), pred)
    parts = wf.predictor_components(wf.ForecastSpec(**SPEC, regressor="pcr"), obs, pred)
    kept = parts["variance"].filter("kept").count()
    assert parts["variance"].agg(F.sum("variance_ratio")).first()[0] == pytest.approx(1) and kept == 1
    assert parts["scores"].count() == 12 * kept and parts["loadings"].agg(F.sum(F.col("loading") ** 2)).first()[0] == pytest.approx(kept)


def test_factors_equal_numpy(spark):
    rng = np.random.default_rng(8)
    n, p, k = 40, 12, 2
    x = rng.normal(size=(n, k)) @ rng.normal(size=(k, p)) + 0.5 * rng.normal(size=(n, p))
    df = spark.createDataFrame([(f"c{j}", x[:, j].tolist()) for j in range(p)], "loc_id string, features array<double>").repartition(3)
    u, _, s = fields.spectrum(fields.products(df, [np.arange(n)], n)[0], np.arange(n))
    z = (x - x.mean(0)) / x.std(0)
    assert s == pytest.approx(np.linalg.svd(z, compute_uv=False)[: len(s)])
    cov = z.T @ z / n
    values, vectors = np.linalg.eigh(cov)
    load = vectors[:, ::-1][:, :k] * np.sqrt(values[::-1][:k])
    noise = np.maximum(np.diag(cov) - (load**2).sum(1), 1e-6)
    for _ in range(5):
        beta = np.linalg.inv(np.eye(k) + (load.T / noise) @ load) @ (load.T / noise)
        load = cov @ beta.T @ np.linalg.inv(np.eye(k) - beta @ load + beta @ cov @ beta.T)
        noise = np.maximum(np.diag(cov - load @ beta @ cov), 1e-6)
    scaled = fields.scaled_field(df)
    got = {r: {x["loc_id"]: x for x in fields.factor_loadings(scaled, u, s, k, r, rounds=5).collect()} for r in ("none", "varimax", "quartimax")}
    own = np.array([got["none"][f"c{j}"]["loadings"] for j in range(p)])
    assert own @ own.T == pytest.approx(load @ load.T, abs=1e-8)
    assert [got["none"][f"c{j}"]["noise"] for j in range(p)] == pytest.approx(noise.tolist())
    simple = lambda m, g: (m**4).sum() - g / p * ((m**2).sum(0) ** 2).sum()
    for kind, gamma in (("varimax", 1.0), ("quartimax", 0.0)):
        turned = np.array([got[kind][f"c{j}"]["loadings"] for j in range(p)])
        assert turned @ turned.T == pytest.approx(load @ load.T, abs=1e-8)
        angles = [simple(own @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]), gamma) for a in np.linspace(0, np.pi, 721)]
        assert simple(turned, gamma) >= max(angles) - 1e-3 * abs(max(angles))
    assert fields.components_needed(np.sqrt([5.0, 3.0, 2.0]), 70) == 2 and fields.components_needed(np.sqrt([5.0, 3.0, 2.0]), 80) == 3


def test_zoning(spark, tmp_path):
    """Two groups of stations with signals of their own become zones of their own."""
    rng = np.random.default_rng(9)
    signals, rows, places = rng.normal(size=(20, 2)), [], []
    for i in range(12):
        side = int(i >= 6)
        places.append((f"s{i}", float(i % 3), side * 10.0 + float(i % 6 // 3)))
        rows += [(f"s{i}", datetime.date(1980 + y, m, 1), float(50 + 10 * signals[y, side] + rng.normal())) for y in range(20) for m in (1, 2, 3)]
    rows += [("gap", datetime.date(1980, m, 1), 1.0) for m in (1, 2, 3)]
    monthly = spark.createDataFrame(rows, "loc_id string, time date, value double")
    points = spark.createDataFrame([*places, ("gap", 0.0, 5.0)], "loc_id string, lat double, lon double")
    out = wf.zoning(wf.ZoningSpec(step=1.0, explained=80.0, zones=2), monthly, points)
    assert out["data"].count() == 12 * 20 and out["components"].select("loc_id").distinct().count() == 12
    assert out["variance"].agg(F.sum("variance_ratio")).first()[0] == pytest.approx(1)
    zone = {(r["lat"], r["lon"]): r["zone"] for r in out["zones"].collect()}
    west, east = ({zone[lat, lon] for n, lat, lon in places if (lon >= 10) == side} for side in (False, True))
    assert len(west) == len(east) == 1 and west != east
    again = wf.zoning(wf.ZoningSpec(step=2.0, interpolation="rbf", rotation="quartimax"), monthly, points)
    assert 2 <= again["zones"].select("zone").distinct().count() <= 16
    costs = [r["inertia"] for r in again["costs"].orderBy("k").collect()]
    assert len(costs) == 16 and costs[0] > costs[1] > costs[-1]
    tables.write_zoning(out, points, f"file://{tmp_path}", "varimax")
    assert spark.read.csv(f"{tmp_path}/data", header=True).count() == 240
    assert spark.read.csv(f"{tmp_path}/components_varimax", header=True).columns == ["station", "k", "value", "Lat", "Lon"]
    raster = netcdf.read(spark, f"{tmp_path}/izones", "Zones")
    assert raster.count() == len(zone) and {(r["lat"], r["lon"]): r["value"] for r in raster.collect()} == zone
    with pytest.raises(wf.TooFewStations):
        wf.zoning(wf.ZoningSpec(), monthly.filter("loc_id = 's1'"), points)
    for bad in (dict(interpolation="spline"), dict(how="max"), dict(zones=0), dict(box=(1, 0, 0, 1)), dict(season="XYZ")):
        with pytest.raises(ValueError):
            wf.ZoningSpec(**bad).validate()


def test_forecast_files(spark, tmp_path):
    obs, pred, _, y = september_and_december(spark, years=12)
    out = wf.forecast(wf.ForecastSpec(**SPEC | {"forecast_year": 1987}, regressor="pcr"), obs, pred)
    points = spark.createDataFrame([(f"c{j}", float(j % 2), float(j // 2)) for j in range(4)], "loc_id string, lat double, lon double")
    for kind in ("parquet", "csv", "netcdf"):
        tables.write_forecast(out, f"file://{tmp_path}/{kind}", "198712_Dec", "sst", "pr", "pcr_ols_kfold", kind=kind, points=points)
        place = f"{tmp_path}/{kind}/198712_Dec/sst/pr/pcr_ols_kfold/output"
        assert spark.read.csv(f"{place}/skill", header=True).count() == 48 if kind != "parquet" else spark.read.parquet(f"{place}/skill").count() == 48
        if kind == "netcdf":
            assert netcdf.read(spark, f"{place}/deterministic-hcst", "value").count() == y.size


def test_specs_refuse_nonsense():
    with pytest.raises(ValueError):
        wf.ForecastSpec(1, "Dec-Feb", (1985, 2000), 2005).validate()
    with pytest.raises(ValueError):
        wf.VerificationSpec("XYZ", 2001, (1980, 2000)).validate()
    with pytest.warns(UserWarning):
        wf.VerificationSpec("DJF", 2001, (1990, 2000)).validate()
    assert wf.VerificationSpec("DJF", 2001, (1980, 2000)).end_year() == 2002
    with pytest.raises(ValueError):
        wf.ZoningSpec((0, 0, 100, 100), step=0.001).validate()
    with pytest.raises(ValueError):
        GridRequest(2000, 2001, lead=0).validate()


def test_verification_layers(spark):
    obs = monthly(spark, ("a", "b", "c"))
    points = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 50.0, 50.0)], "loc_id string, lat double, lon double")
    edges = spark.createDataFrame([("z", 0.0, 0.0, 9.0, 0.0), ("z", 9.0, 0.0, 0.0, 9.0), ("z", 0.0, 9.0, 0.0, 0.0)], "zone_id string, x1 double, y1 double, x2 double, y2 double")
    fc = spark.createDataFrame([("z", "4")], "zone_id string, category string")
    out = wf.verification(wf.VerificationSpec("DJF", 2003, (1983, 2002)), obs, points, edges, fc)
    rows = {r["loc_id"]: r for r in out.collect()}
    assert set(rows) == {"a", "b"}
    values = {(r["loc_id"], r["time"]): r["value"] for r in obs.collect()}
    dates = lambda y: [datetime.date(y - 1, 12, 1), datetime.date(y, 1, 1), datetime.date(y, 2, 1)]
    total = lambda loc, y: sum(values[loc, d] for d in dates(y))
    for loc, r in rows.items():
        clim = [total(loc, y) for y in range(1983, 2003)]
        q = np.quantile(clim, [0.33, 0.5, 0.66])
        now = total(loc, 2004)
        assert r["obs_value"] == pytest.approx(now, abs=0.051) and r["obs_clim"] == pytest.approx(np.mean(clim), abs=0.0051)
        assert r["obs_cemcat"] == 1 + sum(now > x for x in q) and r["fcst_cemhit"] == 3 - abs(4 - r["obs_cemcat"])
        assert r["obs_quantanom"] == pytest.approx(np.mean([c <= now for c in clim]), abs=6e-4)
    means = wf.score_means(out, "zone_id").first()
    assert means["fcst_cemhit"] == pytest.approx(np.mean([r["fcst_cemhit"] for r in rows.values()]))
    assert wf.score_means(out).count() == 1


def test_penalised_folds_equal_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [("a", datetime.date(1980 + i, 1, 1), float(rng.normal()), float(rng.normal() + i / 5)) for i in range(23)]
    folded = align.with_folds(spark.createDataFrame(rows, "loc_id string, time date, x double, y double")).cache()
    data = folded.orderBy("time").collect()
    for penalty, alpha in (("ridge", 2.0), ("lasso", 0.2)):
        got = {r["time"]: r["h"] for r in align.out_of_fold_linear(folded, penalty, alpha).collect()}
        for r in data:
            x, y = (np.array([o[c] for o in data if o["fold"] != r["fold"]]) for c in "xy")
            z, w = (x - x.mean()) / x.std(), 0.0
            ols = z @ (y - y.mean()) / len(x)
            w = ols * len(x) / (len(x) + alpha) if penalty == "ridge" else np.sign(ols) * max(abs(ols) - alpha, 0)
            assert got[r["time"]] == pytest.approx(y.mean() + w * (r["x"] - x.mean()) / x.std())


def test_grid_requests(spark, tmp_path):
    rows = [(datetime.date(2000, m, 1), float(lat), 10.0, lead, float(m + lead)) for m in (1, 2) for lat in (0, 5) for lead in (0.5, 1.5, 2.5)]
    spark.createDataFrame(rows, "time date, lat double, lon double, lead double, value double").write.parquet(str(tmp_path / "g"))
    request = GridRequest(1990, 2000, months=(1,), box=(-1, 1, 0, 20), lead=1, seasonal=True)
    got = fetch(spark, str(tmp_path / "g"), request, str(tmp_path / "out"))
    assert [tuple(r) for r in relabelled(got).collect()] == [(datetime.date(1999, 12, 1), 0.0, 10.0, 2.5)]
    assert fetch(spark, str(tmp_path / "g"), GridRequest(1990, 1991), str(tmp_path / "out")).count() == 1


def test_factors_make_their_field_once(spark):
    """Rounds read the field, not again what it is made from."""
    z = np.random.default_rng(5).normal(size=(20, 6))
    z = (z - z.mean(1, keepdims=True)) / z.std(1, keepdims=True)
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            made.add(len(f))
            yield f

    rows = spark.createDataFrame([(str(i), r.tolist()) for i, r in enumerate(z)], "loc_id string, features array<double>")
    u, _, s = fields.spectrum(z.T @ z, np.arange(6))
    found = fields.factor_loadings(rows.mapInPandas(counted, "loc_id string, features array<double>"), u, s, 2, "varimax", rounds=3)
    assert len(found.collect()) == 20 and made.value == 20
