import itertools

import numpy as np
import pytest

from shapelab.operators import descent
from shapelab.operators.descent import Problem


def table(seed, n, k):
    r = np.random.default_rng(seed)
    return r.normal(size=(n, k)) + np.linspace(0.5, -0.4, k), 1 + np.arange(n) % 3 * 1.0, 0.5 + np.arange(n) % 2


def test_gradient_is_that_of_differences():
    gap, c1, c2 = table(1, 60, 106)
    w = np.random.default_rng(2).uniform(0, 1, (2, 106))
    counts = np.column_stack([np.ones(60), np.arange(60) % 4 > 0]).astype(float)
    cost, grad = descent.sums(gap, c1, c2, counts, w)
    for j in range(106):
        e = np.zeros((2, 106))
        e[:, j] = 1e-5
        up, down = descent.sums(gap, c1, c2, counts, w + e)[0], descent.sums(gap, c1, c2, counts, w - e)[0]
        assert np.allclose((up - down) / 2e-5, grad[:, j], rtol=1e-5, atol=1e-5)
    assert (cost > 0).all()


def plain_minimum(gap, c1, c2, penalty):
    """Accelerated projected gradients with restarts, for as long as it takes."""
    curve = np.linalg.norm(gap, 2) ** 2 * (c1 + c2).max() / 4
    w = v = np.ones(gap.shape[1])
    t = 1.0
    value = lambda w: float(descent.sums(gap, c1, c2, np.ones((len(gap), 1)), w[None])[0][0] + penalty @ w)
    for _ in range(20_000):
        z = gap @ v
        p = 1 / (1 + np.exp(-z))
        g = gap.T @ ((p - 1) * c1 + p * c2) + penalty
        new = np.maximum(v - g / curve, descent.LOWEST)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if (v - new) @ (new - w) > 0:
            t_new = 1.0
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return value(w)


def test_wide_fits_are_minima(spark):
    """106 weights, two datasets, a fold and the whole, two penalties each: the minima of plain numpy, within 1e-6."""
    k, problems, rows = 106, [], []
    tables = {"a": table(3, 240, k), "b": table(4, 150, k)}
    for name, (gap, c1, c2) in tables.items():
        rows += [(name, g.tolist(), float(x), float(y), [i % 3]) for i, (g, x, y) in enumerate(zip(gap, c1, c2))]
    penalties = [tuple(np.where(np.arange(k) < 4, 1.0, x).tolist()) for x in (2.0, 10.0)]
    problems = [Problem(d, f, p) for d, f, p in itertools.product(tables, (None, 1), penalties)]
    df = spark.createDataFrame(rows, "dataset string, gap array<double>, c1 double, c2 double, held array<int>").repartition(3).cache()
    got = descent.minimise(df, problems, [1.0] * k)
    for p, (w, cost) in zip(problems, got):
        gap, c1, c2 = tables[p.dataset]
        use = np.arange(len(gap)) % 3 != 1 if p.fold == 1 else np.ones(len(gap), bool)
        best = plain_minimum(gap[use], c1[use], c2[use], np.array(p.penalty))
        assert (w >= descent.LOWEST).all() and cost <= best + 1e-6 * (1 + abs(best)), (p.dataset, p.fold, cost, best)
        again = descent.sums(gap[use], c1[use], c2[use], np.ones((use.sum(), 1)), w[None])[0][0] + np.array(p.penalty) @ w
        assert abs(again - cost) < 1e-8 * (1 + cost)


def test_free_weights_empty_tables_and_limits(spark):
    gap, c1, c2 = table(5, 80, 3)
    df = spark.createDataFrame([("a", g.tolist(), float(x), float(y), []) for g, x, y in zip(gap - 1, c1, c2)], "dataset string, gap array<double>, c1 double, c2 double, held array<int>").cache()
    (bound, high), (free, least) = [descent.minimise(df, [Problem("a", None, (0.0,) * 3)], [1.0] * 3, low)[0] for low in (None, [-np.inf] * 3)]
    assert least <= high and (free < 0).any() and (bound >= 0).all()
    w, cost = descent.minimise(df.where("false"), [Problem("a", None, (1.0, 1.0, 0.0))], [1.0] * 3)[0]
    assert w[:2].max() < 1e-6 and w[2] == 1 and cost < 1e-5
    with pytest.raises(RuntimeError):
        descent.minimise(df, [Problem("a", None, (0.0,) * 3)], [1.0] * 3, passes=2)
