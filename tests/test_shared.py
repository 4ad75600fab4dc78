"""Trees, forests and networks over all locations against plain ones that see every output."""

import numpy as np
import pytest

from isohyet.operators import fields, models, shared


def plain_tree(x, y, depth):
    """A multi-output tree by trying every cut; leaves are mean rows."""
    best = None
    if depth and len(y) > 1 and np.ptp(y, axis=0).any():
        for c in range(x.shape[1]):
            values = np.unique(x[:, c])
            for a, b in zip(values, values[1:], strict=False):
                go = x[:, c] <= (a + b) / 2
                gain = (y[go].sum(0) ** 2).sum() / go.sum() + (y[~go].sum(0) ** 2).sum() / (~go).sum()
                if best is None or gain > best[0] * (1 + 1e-12):
                    best = gain, c, (a + b) / 2
    if best is None:
        return y.mean(0)
    go = x[:, best[1]] <= best[2]
    return best[1], best[2], plain_tree(x[go], y[go], depth - 1), plain_tree(x[~go], y[~go], depth - 1)


def walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def case(n=24, m=3, outputs=40, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, m)).round(1)  # with ties
    y = np.sin(x @ rng.normal(size=(m, outputs))) + 0.1 * rng.normal(size=(n, outputs)) + rng.normal(size=outputs) * 5
    return x, y, rng.normal(size=(9, m))


@pytest.mark.parametrize("depth", [1, 2, 5])
@pytest.mark.parametrize("outputs", [1, 40])
def test_a_tree_equals_a_plain_one(depth, outputs):
    x, y, new = case(outputs=outputs)
    z = y - y.mean(0)
    tree = plain_tree(x, z, depth)
    assert shared.tree_weights(x, z @ z.T, new, depth) @ y == pytest.approx(np.array([walk(tree, r) for r in new]) + y.mean(0), abs=1e-9)
    if outputs == 1:
        assert shared.tree_weights(x, z @ z.T, new, depth) @ y[:, 0] == pytest.approx(models.tree_predict(x, y[:, 0], new, depth))


def test_a_forest_equals_plain_trees():
    x, y, new = case()
    z = y - y.mean(0)
    rng = np.random.default_rng(models.SEED)
    total = 0
    for _ in range(7):
        i = rng.integers(0, len(x), len(x))
        tree = plain_tree(x[i], z[i], 3)
        total = total + np.array([walk(tree, r) for r in new])
    assert shared.forest_weights(x, z @ z.T, new, trees=7, depth=3) @ y == pytest.approx(total / 7 + y.mean(0), abs=1e-9)


def plain_network(x, y, new, hidden, rounds, rate, ridge):
    """The same training with the outputs and their weights at hand."""
    rng = np.random.default_rng(0)
    xs, ns, n = models.scaled(x), models.scaled(new, x), len(x)
    unit = np.sqrt((y**2).sum() / n)
    y = y / unit
    sizes = [x.shape[1], *hidden]
    w = [rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:], strict=False)]
    b = [np.zeros(k) for k in hidden]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in w + b]

    def run(z):
        out = [z]
        for weight, bias in zip(w, b, strict=True):
            out.append(np.maximum(out[-1] @ weight + bias, 0))
        return out

    for step in range(1, rounds + 1):
        held = run(xs)
        a = held[-1] - held[-1].mean(0)
        v = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ y)  # layer x outputs
        down = (a @ v - y) @ v.T / n  # summed over all outputs
        down -= down.mean(0)
        grads = []
        for i in range(len(w) - 1, -1, -1):
            down = down * (held[i + 1] > 0)
            grads.insert(0, (held[i].T @ down, down.sum(0)))
            down = down @ w[i].T
        for p, g, m in zip(w + b, [g for g, _ in grads] + [g for _, g in grads], moments, strict=True):
            m[0][...] = 0.9 * m[0] + 0.1 * g
            m[1][...] = 0.999 * m[1] + 0.001 * g * g
            p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    last = run(xs)[-1]
    a = last - last.mean(0)
    return (run(ns)[-1] - last.mean(0)) @ np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ y) * unit


def test_a_network_equals_a_plain_one():
    x, y, new = case(outputs=15)
    z = y - y.mean(0)
    options = {"hidden": (6, 4), "rounds": 60, "rate": 1e-2, "ridge": 0.5}
    got = shared.network_weights(x, z @ z.T, new, **options) @ z
    assert got == pytest.approx(plain_network(x, z, new, **options), rel=1e-5, abs=1e-6)
    learned = shared.network_weights(x, z @ z.T, x, **options) @ z
    assert ((learned - z) ** 2).sum() < 0.6 * (z**2).sum()


def test_field_weights_are_one_model_for_all(spark):
    x, y, _ = case(n=20, outputs=30)
    df = spark.createDataFrame([(f"l{j}", y[:, j].tolist()) for j in range(30)], "loc_id string, features array<double>").repartition(4)
    fits = [*fields.fold_fits(20), np.arange(20)]
    k = fields.products(df, fits, 20, scale=False)
    for i, fit in enumerate(fits):
        tree = plain_tree(x[fit], y[fit] - y[fit].mean(0), 2)
        want = np.array([walk(tree, r) for r in x]) + y[fit].mean(0)
        assert fields.shared_weights(x, k[i], fit, 20, "tree") @ y == pytest.approx(want, abs=1e-8)


def test_even_outputs_and_single_rows():
    x, new = np.arange(4.0)[:, None], np.array([[0.5], [9.0]])
    assert shared.tree_weights(x, np.zeros((4, 4)), new) == pytest.approx(np.full((2, 4), 0.25))
    assert shared.tree_weights(x[:1], np.ones((1, 1)), new) == pytest.approx(np.ones((2, 1)))
    assert np.isfinite(shared.network_weights(x, np.zeros((4, 4)), new, rounds=3)).all()
