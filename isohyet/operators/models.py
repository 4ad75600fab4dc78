"""Regressors of several predictors as numpy inside tasks, principal components of wide rows, radial bases and clusters.

A regressor sees one station's years by predictors - tens of rows - whatever the input; Spark spreads the stations.
Models that join the cells of a field are in `fields`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.operators import lineage, radial

MAX_FRACTION, PCA_VARIANCE = 0.15, 0.95
SEED = 42
MOST_STATIONS = 5_000  # of a radial basis solved in one task: their matrix of distances is 200 MB


def component_limit(n: int, cumulative: list[float]) -> int:
    """Principal components that a regression on n rows may keep; 0 for too few rows."""
    enough = next((i + 1 for i, v in enumerate(cumulative) if v >= PCA_VARIANCE), 1)
    return int(np.ceil(min(int(MAX_FRACTION * n), enough)))


def scaled(x: np.ndarray, like: np.ndarray | None = None) -> np.ndarray:
    like = x if like is None else like
    deviation = like.std(0)
    return (x - like.mean(0)) / np.where(deviation == 0, 1, deviation)


def principal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components (rows) of centred data and their shares of the variance; the largest loading is positive."""
    _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    signs = np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])
    total = (s**2).sum()
    return v * np.where(signs == 0, 1, signs)[:, None], s**2 / total if total else s


def covariance(df: DataFrame, features: str = "features") -> DataFrame:
    """(i, j, cov) with i <= j of array columns of one length: products are summed in the tasks, then by cell in Spark."""

    def sums(frames):
        n, s, ss = 0, None, None
        for f in frames:
            if len(f):
                x = np.stack(f[features].to_numpy()).astype(float)
                n, s, ss = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if ss is None else ss)
        if n:
            i, j = np.triu_indices(len(s))
            yield pd.DataFrame({"i": i, "j": j, "n": n, "si": s[i], "sj": s[j], "ss": ss[i, j]})

    parts = df.filter(F.col(features).isNotNull()).select(features).mapInPandas(sums, "i int, j int, n long, si double, sj double, ss double")
    total = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "si", "sj", "ss")))
    return total.select("i", "j", (F.col("ss") / F.col("n") - F.col("si") / F.col("n") * F.col("sj") / F.col("n")).alias("cov"))


def gram_pca(df: DataFrame, features: str = "features") -> DataFrame:
    """(k, variance_ratio, cumulative) of array columns of one length; their covariance, a cell a pair of places in the
    array, is all that the driver sees."""
    cells = covariance(df, features).collect()
    width = max((r["j"] + 1 for r in cells), default=0)
    cov = np.zeros((width, width))
    for r in cells:
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["cov"]
    values = np.sort(np.linalg.eigvalsh(cov))[::-1].clip(0) if width else np.zeros(0)
    ratio = values / (values.sum() or 1.0)
    return df.sparkSession.createDataFrame([(i + 1, float(r), float(c)) for i, (r, c) in enumerate(zip(ratio, ratio.cumsum(), strict=True))], "k int, variance_ratio double, cumulative double")


def _tree(x: np.ndarray, y: np.ndarray, depth: int):
    """A regression tree as nested (column, cut, left, right), leaves are means."""
    if depth == 0 or len(y) < 2 or np.ptp(y) == 0:
        return float(y.mean())
    best = None
    for c in range(x.shape[1]):
        order = np.argsort(x[:, c], kind="stable")
        xs, ys = x[order, c], y[order]
        k = np.arange(1, len(ys))
        left, total = ys.cumsum()[:-1], ys.sum()
        gain = left**2 / k + (total - left) ** 2 / (len(ys) - k)
        gain[xs[1:] == xs[:-1]] = -np.inf
        if len(gain) and np.isfinite(gain.max()) and (best is None or gain.max() > best[0]):
            i = int(gain.argmax())
            best = (gain[i], c, (xs[i] + xs[i + 1]) / 2)
    if best is None:
        return float(y.mean())
    go = x[:, best[1]] <= best[2]
    return best[1], best[2], _tree(x[go], y[go], depth - 1), _tree(x[~go], y[~go], depth - 1)


def _walk(tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def tree_predict(x, y, new, depth: int = 2) -> np.ndarray:
    tree = _tree(x, y, depth)
    return np.array([_walk(tree, r) for r in new])


def forest_predict(x, y, new, trees: int = 100, depth: int = 5) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    out = np.zeros(len(new))
    for _ in range(trees):
        i = rng.integers(0, len(y), len(y))
        out += tree_predict(x[i], y[i], new, depth)
    return out / trees


def mlp_predict(x, y, new, hidden: tuple[int, int] = (50, 25), rounds: int = 1000, rate: float = 1e-3) -> np.ndarray:
    """A network with two rectified layers, trained on all rows at once with Adam; y is scaled meanwhile."""
    rng = np.random.default_rng(0)
    xs, ns = scaled(x), scaled(new, x)
    my, sy = y.mean(), y.std() or 1.0
    t = (y - my) / sy
    sizes = [x.shape[1], *hidden, 1]
    w = [rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:], strict=False)]
    b = [np.zeros(n) for n in sizes[1:]]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in w + b]
    for step in range(1, rounds + 1):
        a1 = np.maximum(xs @ w[0] + b[0], 0)
        a2 = np.maximum(a1 @ w[1] + b[1], 0)
        d3 = (a2 @ w[2] + b[2] - t[:, None]) / len(t)
        d2 = (d3 @ w[2].T) * (a2 > 0)
        d1 = (d2 @ w[1].T) * (a1 > 0)
        grads = [xs.T @ d1, a1.T @ d2, a2.T @ d3, d1.sum(0), d2.sum(0), d3.sum(0)]
        for p, g, m in zip(w + b, grads, moments, strict=True):
            m[0][...] = 0.9 * m[0] + 0.1 * g
            m[1][...] = 0.999 * m[1] + 0.001 * g * g
            p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    a2 = np.maximum(np.maximum(ns @ w[0] + b[0], 0) @ w[1] + b[1], 0)
    return (a2 @ w[2] + b[2])[:, 0] * sy + my


def pcr_predict(x, y, new) -> np.ndarray:
    """Least squares on the leading principal components of the scaled predictors."""
    xs, ns = scaled(x), scaled(new, x)
    v, ratio = principal(xs)
    k = max(1, component_limit(len(y), ratio.cumsum().tolist()))
    a = np.column_stack([np.ones(len(y)), xs @ v[:k].T])
    w = np.linalg.lstsq(a, y, rcond=None)[0]
    return np.column_stack([np.ones(len(new)), ns @ v[:k].T]) @ w


def ols_predict(x, y, new) -> np.ndarray:
    w = np.linalg.lstsq(np.column_stack([np.ones(len(y)), x]), y, rcond=None)[0]
    return np.column_stack([np.ones(len(new)), new]) @ w


def ridge_predict(x, y, new, alpha: float = 1.0) -> np.ndarray:
    mx, my = x.mean(0), y.mean()
    w = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return my + (new - mx) @ w


def lasso_predict(x, y, new, alpha: float = 0.01, rounds: int = 500) -> np.ndarray:
    """Coordinate descent on half the mean squared error plus alpha times the sum of weights."""
    mx, my = x.mean(0), y.mean()
    z, left = x - mx, y - my
    w, size = np.zeros(x.shape[1]), np.maximum((z**2).mean(0), 1e-300)
    for _ in range(rounds):
        old = w.copy()
        for j in range(len(w)):
            c = z[:, j] @ left / len(y) + size[j] * w[j]
            new_w = np.sign(c) * max(abs(c) - alpha, 0) / size[j]
            left = left - z[:, j] * (new_w - w[j])
            w[j] = new_w
        if np.abs(w - old).max(initial=0) <= 1e-12 * max(1.0, np.abs(w).max(initial=0)):
            break
    return my + (new - mx) @ w


#: The regressors by name.
REGRESSORS = {"ols": ols_predict, "ridge": ridge_predict, "lasso": lasso_predict, "tree": tree_predict, "forest": forest_predict, "mlp": mlp_predict, "pcr": pcr_predict}


def out_of_fold(folded: DataFrame, regressor: str, features: str = "features", key: str = "loc_id", **options) -> DataFrame:
    """(loc_id, time, y, h) of rows (loc_id, time, features ARRAY, y, fold), fitted per location on the other folds."""
    predict = REGRESSORS[regressor]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("time")
        x, y, fold = np.stack(f[features].to_numpy()).astype(float), f["y"].to_numpy(float), f["fold"].to_numpy()
        h = np.full(len(y), np.nan)
        for k in np.unique(fold):
            out = fold == k
            if (~out).sum() >= 2:
                h[out] = predict(x[~out], y[~out], x[out], **options)
        return pd.DataFrame({key: f[key], "time": f["time"], "y": y, "h": h})

    return folded.groupBy(key).applyInPandas(run, f"{key} string, time date, y double, h double")


def fitted(pairs: DataFrame, new: DataFrame, regressor: str, features: str = "features", key: str = "loc_id", **options) -> DataFrame:
    """(loc_id, time, h) of new rows (loc_id, time, features), from each location's own rows (loc_id, time, features, y)."""
    predict = REGRESSORS[regressor]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("time")
        known = f["y"].notna().to_numpy()
        x, y = np.stack(f[features].to_numpy()).astype(float), f["y"].to_numpy(float)
        h = predict(x[known], y[known], x[~known], **options) if known.sum() >= 2 and (~known).any() else np.full(int((~known).sum()), np.nan)
        return pd.DataFrame({key: f[key][~known], "time": f["time"][~known], "h": h})

    both = pairs.select(key, "time", features, "y").unionByName(new.select(key, "time", features, F.lit(None).cast("double").alias("y")))
    return both.groupBy(key).applyInPandas(run, f"{key} string, time date, h double")


def rbf_weights(lon: np.ndarray, lat: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Weights of the stations' distances that reproduce their values; no two stations at one place."""
    return np.linalg.solve(np.hypot(lon[:, None] - lon, lat[:, None] - lat), value) if len(value) > 1 else np.zeros(len(value))


def rbf(grid: DataFrame, stations: DataFrame, keys: list[str], most: int = MOST_STATIONS, **options) -> DataFrame:
    """Linear radial basis interpolation, of any number of stations. Up to `most`, whose matrix fits into one task, are
    solved for there; more by blocks, see `radial`, whose options may be given."""
    known = lineage.cut(radial.places(stations))
    count = known.count()
    if count > most:
        weights = radial.weights(known, count, **options)
        groups = (max(1, -(-n // options.get("group", radial.GROUP))) for n in (grid.count(), count))
        return radial.distance_sums(grid, weights, keys, *groups)

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        return f.assign(w=rbf_weights(f["lon"].to_numpy(float), f["lat"].to_numpy(float), f["value"].to_numpy(float)))[["lon", "lat", "w"]]

    weights = known.groupBy(F.lit(1).alias("_g")).applyInPandas(solve, "lon double, lat double, w double")
    held = weights.agg(F.collect_list(F.struct("lon", "lat", "w")).alias("_s"))
    dist = lambda s: F.hypot(s["lon"] - F.col("lon"), s["lat"] - F.col("lat"))
    return grid.crossJoin(F.broadcast(held)).select(*keys, F.aggregate("_s", F.lit(0.0), lambda a, s: a + dist(s) * s["w"]).alias("value"))


def total_inertia(df: DataFrame, features: str = "features") -> float:
    """The cost of a single cluster: squared distances to the mean, from one aggregate by place in the arrays."""
    cells = df.select(F.posexplode(F.col(features).cast("array<double>")).alias("i", "v"))
    spread = cells.groupBy("i").agg((F.var_pop("v") * F.count("v")).alias("s"))
    return float(spread.agg(F.sum("s")).first()[0] or 0.0)


def kmeans_costs(df: DataFrame, most: int = 16, features: str = "features") -> list[tuple[int, float]]:
    """(k, inertia) for 1 to `most` clusters, or to the number of different rows if that is less."""
    v = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("v"), F.col(features)).cache()
    most = min(most, v.select(features).distinct().limit(most).count())
    out = [(1, total_inertia(v, features))] if most else []
    out += [(k, float(KMeans(k=k, seed=SEED, featuresCol="v").fit(v).summary.trainingCost)) for k in range(2, most + 1)]
    v.unpersist()
    return out


def elbow(costs: list[tuple[int, float]]) -> int:
    """The k farthest from the line between the first and the last cost; of ties the largest."""
    (k0, c0), (k1, c1) = costs[0], costs[-1]
    if k0 == k1:
        return k0
    a = (c1 - c0) / (k1 - k0)
    return max(costs, key=lambda kc: (abs(a * kc[0] - kc[1] + c0 - k0 * a) / np.hypot(a, 1), kc[0]))[0]


def kmeans_zones(df: DataFrame, k: int | None = None, features: str = "features") -> DataFrame:
    """df with `zone`, 1 to k; without a k the elbow of the costs chooses it."""
    k = k or elbow(kmeans_costs(df, features=features))
    if k == 1:
        return df.withColumn("zone", F.lit(1))
    v = df.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    model = KMeans(k=k, seed=SEED, featuresCol="_v", predictionCol="_z").fit(v)
    return model.transform(v).withColumn("zone", (F.col("_z") + 1).cast("int")).drop("_v", "_z")
