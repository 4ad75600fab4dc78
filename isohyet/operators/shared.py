"""Trees, forests and networks of many outputs: one model for all locations, on predictors that they share.

A split's gain, and a shared layer's gradient, are sums over all outputs of squares and products of their values at two
times. So all that a model needs of the outputs is the matrix of these sums, times by times, which `fields.products` makes
in the tasks and Spark adds up; from then on costs don't grow with the locations. What a model gives goes back to each
location as weights on its own values: a leaf is a mean of some of them, and an output weight a combination of them.
"""

from __future__ import annotations

import numpy as np

from isohyet.operators.models import SEED, scaled

TREES, FOREST_DEPTH, TREE_DEPTH = 100, 5, 2
HIDDEN, ROUNDS, RATE, RIDGE = (50, 25), 1000, 1e-3, 1.0


def _best_split(x: np.ndarray, k: np.ndarray, rows: np.ndarray) -> tuple[int, float] | None:
    """Column and cut with the largest gain, summed over all outputs; of equal ones the first."""
    n, best = len(rows), None
    inner = k[np.ix_(rows, rows)]
    total, by_row = inner.sum(), inner.sum(1)
    if total / n >= np.trace(inner) * (1 - 1e-12):
        return None  # all outputs are the same in all rows
    for c in range(x.shape[1]):
        order = np.argsort(x[rows, c], kind="stable")
        xs = x[rows[order], c]
        size = np.arange(1, n)
        left = np.diagonal(inner[np.ix_(order, order)].cumsum(0).cumsum(1))[:-1]
        right = total - 2 * by_row[order].cumsum()[:-1] + left
        gain = np.where(xs[1:] == xs[:-1], -np.inf, left / size + right / (n - size))
        if n > 1 and np.isfinite(gain.max()) and (best is None or gain.max() > best[0] + 1e-12 * abs(best[0])):
            i = int(gain.argmax())
            best = (gain[i], c, (xs[i] + xs[i + 1]) / 2)
    return best and best[1:]


def tree_weights(x: np.ndarray, k: np.ndarray, new: np.ndarray, depth: int = TREE_DEPTH, rows: np.ndarray | None = None) -> np.ndarray:
    """Weights, a row for each new row, on the values at the rows of x that a regression tree over all outputs predicts
    with. k has the sums over the outputs of products of their values at two rows; rows may repeat."""
    out = np.zeros((len(new), len(x)))

    def grow(rows: np.ndarray, at: np.ndarray, left: int) -> None:
        cut = _best_split(x, k, rows) if left and len(rows) > 1 else None
        if cut is None:
            out[at] += np.bincount(rows, minlength=len(x)) / len(rows)
            return
        column, value = cut
        low, go = x[rows, column] <= value, new[at, column] <= value
        grow(rows[low], at[go], left - 1)
        grow(rows[~low], at[~go], left - 1)

    grow(np.arange(len(x)) if rows is None else rows, np.arange(len(new)), depth)
    return out


def forest_weights(x: np.ndarray, k: np.ndarray, new: np.ndarray, trees: int = TREES, depth: int = FOREST_DEPTH) -> np.ndarray:
    """The mean of trees, each over rows drawn with replacement."""
    rng = np.random.default_rng(SEED)
    return sum(tree_weights(x, k, new, depth, rng.integers(0, len(x), len(x))) for _ in range(trees)) / trees


def network_weights(x: np.ndarray, k: np.ndarray, new: np.ndarray, hidden: tuple[int, ...] = HIDDEN, rounds: int = ROUNDS, rate: float = RATE, ridge: float = RIDGE) -> np.ndarray:
    """The same of a network with rectified layers that all outputs share. k is of outputs with mean 0. In each round the
    output weights are the ridge regression on the last layer, a combination of the outputs' values, and the shared
    layers follow the gradient of the squared error, summed over all outputs, by Adam."""
    rng = np.random.default_rng(0)
    xs, ns, n = scaled(x), scaled(new, x), len(x)
    k = k / max(np.trace(k) / n, 1e-300)
    sizes = [x.shape[1], *hidden]
    w = [rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:], strict=False)]
    b = [np.zeros(m) for m in hidden]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in w + b]

    def layers(z: np.ndarray) -> list[np.ndarray]:
        out = [z]
        for weight, bias in zip(w, b, strict=True):
            out.append(np.maximum(out[-1] @ weight + bias, 0))
        return out

    def output(a: np.ndarray) -> np.ndarray:
        return np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T)

    for step in range(1, rounds + 1):
        held = layers(xs)
        a = held[-1] - held[-1].mean(0)
        m = output(a)
        down = (a @ m - np.eye(n)) @ k @ m.T / n
        down -= down.mean(0)
        grads_w, grads_b = [], []
        for i in range(len(w) - 1, -1, -1):
            down = down * (held[i + 1] > 0)
            grads_w.insert(0, held[i].T @ down)
            grads_b.insert(0, down.sum(0))
            down = down @ w[i].T
        for p, g, held_m in zip(w + b, grads_w + grads_b, moments, strict=True):
            held_m[0][...] = 0.9 * held_m[0] + 0.1 * g
            held_m[1][...] = 0.999 * held_m[1] + 0.001 * g * g
            p -= rate * (held_m[0] / (1 - 0.9**step)) / (np.sqrt(held_m[1] / (1 - 0.999**step)) + 1e-8)
    last = layers(xs)[-1]
    return (layers(ns)[-1] - last.mean(0)) @ output(last - last.mean(0))


#: The models by name: weights on the fitted rows from (x, k, new).
SHARED = {"tree": tree_weights, "forest": forest_weights, "mlp": network_weights}
