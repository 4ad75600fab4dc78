"""Principal components, canonical correlations and factors of fields: many series over few times.

A field is (loc_id, features ARRAY): a value a time, for each cell or station. Times are few - years of a record - and
cells are many, so everything that joins cells is a sum over them: products of times with times (`products`), made in
the tasks and added up by Spark. The driver solves matrices of times by times only; results go back to the cells as
weights on their own series. No cell meets another in a task.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.operators.lineage import cut
from isohyet.operators.models import MAX_FRACTION, PCA_VARIANCE, REGRESSORS, component_limit
from isohyet.operators.shared import SHARED

FACTOR_ROUNDS, TURN_ROUNDS, FACTOR_CHANGE = 30, 2000, 1e-4
MOST_TIMES = 2000  # times of a field; their products are solved on the driver


def shared_times(a: DataFrame, b: DataFrame) -> list[datetime.date]:
    """The times that both series tables have, in order; a record has few of them."""
    found = a.select("time").intersect(b.select("time")).limit(MOST_TIMES + 1).collect()
    if len(found) > MOST_TIMES:
        raise ValueError(f"more than {MOST_TIMES} times")
    return sorted(r["time"] for r in found)


def field(df: DataFrame, times: list[datetime.date], key: str = "loc_id") -> DataFrame:
    """(loc_id, features) of the locations of (loc_id, time, value) that have a value at each of the times."""
    held = df.filter(F.col("time").isin(times) & F.col("value").isNotNull())
    rows = held.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("time", "value"))).alias("_s"))
    return rows.filter(F.size("_s") == len(times)).select(key, F.col("_s.value").cast("array<double>").alias("features"))


def filled_field(df: DataFrame, times: list[datetime.date], least: float = 0.5, key: str = "loc_id") -> DataFrame:
    """The field of locations with a value at no less than this share of the times; gaps take the location's mean."""
    held = df.filter(F.col("time").isin(times) & F.col("value").isNotNull())
    rows = held.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("time", "value"))).alias("_v"), F.avg("value").alias("_m"), F.count(F.lit(1)).alias("_n"))
    whole = F.transform(F.array(*map(F.lit, times)), lambda t: F.coalesce(F.try_element_at("_v", t), F.col("_m")))
    return rows.filter(F.col("_n") >= least * len(times)).select(key, whole.cast("array<double>").alias("features"))


def _standardised(x: np.ndarray, fit: np.ndarray) -> np.ndarray:
    mean, deviation = x[:, fit].mean(1, keepdims=True), x[:, fit].std(1, keepdims=True)
    return (x - mean) / np.where(deviation == 0, 1, deviation)


def products(df: DataFrame, fits: list[np.ndarray], n: int, scale: bool = True) -> np.ndarray:
    """For each fit - the places of its times - the n x n products of times, summed over the cells, with every cell at mean
    0 and, unless scale is off, deviation 1 over the times of the fit."""
    upper = np.triu_indices(n)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(fits), n, n))
        for f in frames:
            if len(f):
                x = np.stack(f["features"].to_numpy()).astype(float)
                for i, fit in enumerate(fits):
                    z = _standardised(x, fit) if scale else x - x[:, fit].mean(1, keepdims=True)
                    total[i] += z.T @ z
        for i, t in enumerate(total):
            yield pd.DataFrame({"fit": i, "a": upper[0], "b": upper[1], "v": t[upper]})

    parts = df.select("features").mapInPandas(sums, "fit int, a int, b int, v double")
    out = np.zeros((len(fits), n, n))
    for r in parts.groupBy("fit", "a", "b").agg(F.sum("v").alias("v")).collect():  # times by times, whatever the cells
        out[r["fit"], r["a"], r["b"]] = out[r["fit"], r["b"], r["a"]] = r["v"]
    return out


def spectrum(k: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the products of one fit: its components over the times of the fit (columns, of length 1, with the largest
    entry positive), those of all times, and the singular values."""
    values, vectors = np.linalg.eigh(k[np.ix_(fit, fit)])
    held = values > max(float(values[-1]), 0) * 1e-10
    s, u = np.sqrt(values[held][::-1]), vectors[:, held][:, ::-1]
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1, 1)
    return u, k[:, fit] @ u / s**2, s


def shares(s: np.ndarray) -> np.ndarray:
    return s**2 / (s**2).sum() if len(s) else s


def contributions(u: np.ndarray, s: np.ndarray) -> list[list[float]]:
    """Weights on a cell's scaled series that give its loadings, a row a component."""
    return (u / s).T.tolist()


def _weighted(series: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(series, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def scaled_field(df: DataFrame) -> DataFrame:
    """The field with each cell's series at mean 0 and population deviation 1; an even series is 0."""
    n = F.size("features")
    mean = F.aggregate("features", F.lit(0.0), lambda a, x: a + x) / n
    centred = df.withColumn("_m", mean).withColumn("features", F.transform("features", lambda x: x - F.col("_m"))).drop("_m")
    deviation = F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x) / n)
    return centred.withColumn("_d", deviation).withColumn("features", F.transform("features", lambda x: F.coalesce(x / F.nullif(F.col("_d"), F.lit(0.0)), F.lit(0.0)))).drop("_d")


def loadings(df: DataFrame, u: np.ndarray, s: np.ndarray, key: str = "loc_id") -> DataFrame:
    """(loc_id, loadings ARRAY): the components of each cell of a scaled field."""
    return df.select(key, F.array(*(_weighted(F.col("features"), w) for w in contributions(u, s))).alias("loadings"))


def _mean_and(fit: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Weights on all n times from weights on centred times of the fit: the mean of the fit, plus those."""
    out = np.zeros((len(w), n))
    out[:, fit] = 1 / len(fit) + w - w.mean(1, keepdims=True)
    return out


def kept_components(s: np.ndarray, n: int) -> int:
    """Principal components that a regression on n times keeps."""
    return max(1, min(len(s), component_limit(n, shares(s).cumsum().tolist())))


def principal_weights(kx: np.ndarray, fit: np.ndarray, n: int, ridge: float = 0.0) -> np.ndarray:
    """Weights on a location's n values that predict all times of kx by least squares - or ridge - on the principal
    components of the predictors, fitted on the times `fit`."""
    u, every, s = spectrum(kx, fit)
    k = kept_components(s, len(fit))
    return _mean_and(fit, (every[:, :k] * (s[:k] ** 2 / (s[:k] ** 2 + ridge))) @ u[:, :k].T, n)


def _enough(s: np.ndarray) -> int:
    cumulative = shares(s).cumsum()
    return int(np.argmax(cumulative >= PCA_VARIANCE)) + 1 if (cumulative >= PCA_VARIANCE).any() else len(s)


def canonical_parts(kx: np.ndarray, ky: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Canonical analysis of the leading principal components of two fields: scores of the first over all times and of
    the second over those of the fit, the second's rotation and components, and the correlations."""
    ux, every, sx = spectrum(kx, fit)
    uy, _, sy = spectrum(ky, fit)
    px, py = _enough(sx), _enough(sy)
    a, r, b = np.linalg.svd(ux[:, :px].T @ uy[:, :py], full_matrices=False)
    k = max(1, min(px, py, int(MAX_FRACTION * len(fit))))
    return every[:, :px] @ a[:, :k], uy[:, :py] @ b[:k].T, b[:k], uy[:, :py], r[:k].clip(0, 1)


def canonical_weights(kx: np.ndarray, ky: np.ndarray, fit: np.ndarray, n: int, regressor: str = "ols", **options) -> np.ndarray:
    """Weights on a location's n values that predict all times of kx: scores of the predictand are regressed on those of
    the predictors, turned back into its principal components, and these into its values."""
    x, y, rotation, components, _ = canonical_parts(kx, ky, fit)
    if regressor in SHARED:
        centred = y - y.mean(0)
        predicted = y.mean(0) + SHARED[regressor](x[fit], centred @ centred.T, x, **options) @ centred
    else:
        predicted = np.column_stack([REGRESSORS[regressor](x[fit], y[:, j], x, **options) for j in range(y.shape[1])])
    return _mean_and(fit, predicted @ rotation @ components.T, n)


def shared_weights(x: np.ndarray, ky: np.ndarray, fit: np.ndarray, n: int, regressor: str, **options) -> np.ndarray:
    """Weights on a location's n values that predict all rows of x by one tree, forest or network over all locations,
    fitted on the times `fit`; ky has the products of the locations' values over that fit."""
    return _mean_and(fit, SHARED[regressor](x[fit], ky[np.ix_(fit, fit)], x, **options), n)


def fold_fits(n: int, folds: int | None = 5) -> list[np.ndarray]:
    """The times of the training rows of each fold: contiguous folds, the first ones larger by one; None leaves one out."""
    blocks = np.array_split(np.arange(n), min(n, folds or n))
    return [np.setdiff1d(np.arange(n), b) for b in blocks]


def out_of_fold_weights(weights, fits: list[np.ndarray], n: int) -> np.ndarray:
    """n x n: the rows of each fold from the weights that its fit gives; weights(i, fit) are rows for all times."""
    out = np.zeros((n, n))
    for i, fit in enumerate(fits):
        held = np.setdiff1d(np.arange(n), fit)
        out[held] = weights(i, fit)[held]
    return out


def dated(df: DataFrame, times: list[datetime.date], columns: dict[str, Column], key: str = "loc_id") -> DataFrame:
    """(loc_id, time, ...) from array columns with a value a time."""
    rows = df.sparkSession.createDataFrame([(times,)], "_t array<date>")
    each = df.join(F.broadcast(rows), how="cross").select(key, F.explode(F.arrays_zip(F.col("_t").alias("time"), *(c.alias(n) for n, c in columns.items()))).alias("_r"))
    return each.select(key, "_r.time", *(F.col(f"_r.{n}") for n in columns))


def applied(df: DataFrame, weights: np.ndarray, times: list[datetime.date], key: str = "loc_id", with_values: bool = False) -> DataFrame:
    """(loc_id, time, h): every series of a field times a small matrix, a row a time; with_values adds the series, as y."""
    small = df.sparkSession.createDataFrame([(weights.tolist(),)], "_w array<array<double>>")
    dot = lambda w: F.aggregate(F.zip_with("features", w, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    each = df.join(F.broadcast(small), how="cross").select(key, "features", F.transform("_w", dot).alias("_h"))
    return dated(each, times, ({"y": F.col("features")} if with_values else {}) | {"h": F.col("_h")}, key)


def _factor_step(z: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loadings and noise of cells (rows of z) from what the last round summed up; without it, from principal weights."""
    n = z.shape[1]
    if state is None:
        load = z @ first
        return load, np.maximum((z**2).mean(1) - (load**2).sum(1), 1e-6)
    expected, inverse = state
    shared = z @ expected / n
    load = shared @ inverse
    return load, np.maximum((z**2).mean(1) - (load * shared).sum(1), 1e-6)


def rotation_of(fourth: np.ndarray, second: np.ndarray, cells: int, kind: str) -> np.ndarray:
    """The varimax or quartimax rotation of loadings, from sums over the cells alone: products of four loadings (k*k x
    k*k) and of two (k x k). What the rotation makes large is a function of these."""
    gamma, k, size = {"varimax": 1.0, "quartimax": 0.0}[kind], len(second), 0.0
    turn = np.eye(k)
    for _ in range(TURN_ROUNDS):
        cubes = np.column_stack([(fourth @ np.outer(t, t).ravel()).reshape(k, k) @ t for t in turn.T])
        squares = ((second @ turn) * turn).sum(0)
        a, values, b = np.linalg.svd(cubes - gamma * (second @ turn) * squares / cells)
        turn = a @ b
        if values.sum() <= size * (1 + 1e-12):
            break
        size = values.sum()
    return turn


def factor_loadings(df: DataFrame, u: np.ndarray, s: np.ndarray, k: int, rotation: str = "none", key: str = "loc_id", rounds: int = FACTOR_ROUNDS) -> DataFrame:
    """(loc_id, loadings ARRAY, noise) of a factor model of a scaled field, by expectation-maximisation, then a rotation.

    A round needs of the last one only expected factors by time and their products, so each is one sum over the cells;
    the rotation needs one sum more."""
    df = cut(df)  # or each of the rounds would make the field anew, from all the rows behind it
    n, k = len(u), min(k, len(s))
    first = u[:, :k] / np.sqrt(n)
    state, last = None, None

    def summed(function, width: int, height: int) -> np.ndarray:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((height, width))
            for f in frames:
                if len(f):
                    total += function(np.stack(f["features"].to_numpy()).astype(float))
            yield pd.DataFrame({"i": np.arange(height * width), "v": total.ravel()})

        out = np.zeros(height * width)
        for r in df.select("features").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        return out.reshape(height, width)

    for _ in range(rounds):

        def parts(z: np.ndarray, state=state) -> np.ndarray:
            load, noise = _factor_step(z, state, first)
            over = load / noise[:, None]
            return np.vstack([load.T @ over, z.T @ over])

        both = summed(parts, k, k + n)
        posterior = np.linalg.inv(np.eye(k) + both[:k])
        expected = both[k:] @ posterior  # factors by time
        moments = posterior + expected.T @ expected / n
        state = expected, np.linalg.inv(moments)
        if last is not None and np.abs(expected - last).max() < FACTOR_CHANGE:
            break
        last = expected
    turn = np.eye(k)
    if rotation != "none":
        i, j = np.triu_indices(k)

        def fourth(z: np.ndarray, state=state) -> np.ndarray:
            load = _factor_step(z, state, first)[0]
            pairs = load[:, i] * load[:, j]
            return np.vstack([pairs.T @ pairs, pairs.sum(0)[None]])

        moments = summed(fourth, len(i), len(i) + 1)
        at = np.zeros((k, k), np.int64)
        at[i, j] = at[j, i] = np.arange(len(i))
        turn = rotation_of(moments[:-1][at.ravel()][:, at.ravel()], moments[-1][at], max(1, df.count()), rotation)

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                load, noise = _factor_step(np.stack(f["features"].to_numpy()).astype(float), state, first)
                yield pd.DataFrame({key: f[key], "loadings": list(load @ turn), "noise": noise})

    return df.select(key, "features").mapInPandas(finish, f"{key} string, loadings array<double>, noise double")


def components_needed(s: np.ndarray, explained: float) -> int:
    """Components whose cumulative share of the variance, in per cent, first goes beyond what is asked for."""
    return min(len(s), int((np.round(shares(s).cumsum() * 100, 1) <= explained).sum()) + 1)


def component_scores(kx: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """Scores of all times on the kept principal components of a fit."""
    _, every, s = spectrum(kx, fit)
    k = kept_components(s, len(fit))
    return every[:, :k] * s[:k]


def regressed(df: DataFrame, folds: list[tuple[np.ndarray, np.ndarray]], regressor: str, key: str = "loc_id", **options) -> DataFrame:
    """(loc_id, h ARRAY) of the field: a regressor fitted for each location on features that all locations share.

    folds: pairs of features (times x components, perhaps with further times) and the times to fit on; all other rows of
    a pair are predicted, and h holds them one pair after the other."""
    predict = REGRESSORS[regressor]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for y in f["features"]:
                y, out = np.asarray(y, float), []
                for x, fit in folds:
                    out.extend(predict(x[fit], y[fit], x[np.setdiff1d(np.arange(len(x)), fit)], **options))
                found.append(out)
            yield pd.DataFrame({key: f[key], "h": found})

    return df.select(key, "features").mapInPandas(run, f"{key} string, h array<double>")


def rows_of(df: DataFrame, n: int) -> np.ndarray:
    """The series of a field of few cells as columns, a row for each of n times."""
    found = df.orderBy("loc_id").limit(MOST_TIMES + 1).collect()
    if len(found) > MOST_TIMES:
        raise ValueError(f"more than {MOST_TIMES} predictors; take their principal components")
    return np.array([r["features"] for r in found], float).reshape(-1, n).T
