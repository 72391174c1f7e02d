import numpy as np

from shapelab.operators import descent
from shapelab.plans import grid

DIR = "/root/testdata/sf0.001"


def test_folds_and_what_they_hold_out(spark):
    r = np.random.default_rng(1)
    rows = [("x" if i % 3 else "y", i, *map(int, r.integers(0, 12, 3))) for i in range(323)] + [("z", 900 + i, 1, 2, 3) for i in range(4)]
    t = grid.held(grid.folded(spark.createDataFrame(rows, "dataset string, t long, a long, b long, c long")).cache()).collect()
    assert len(t) == len(rows)
    for d in "xyz":
        sizes = np.bincount([x.fold for x in t if x.dataset == d], minlength=grid.FOLDS)
        assert len(sizes) == grid.FOLDS and sizes.max() - sizes.min() <= 1
    pairs = lambda x: {(x.dataset, *sorted((x.a, k))) for k in (x.b, x.c)}
    for x in t:
        assert x.held == sorted({y.fold for y in t if pairs(x) & pairs(y)}) and x.fold in x.held
    assert grid.held(grid.folded(spark.createDataFrame([], "dataset string, t long, a long, b long, c long"))).count() == 0


def test_grid_and_cases(spark):
    """Every fold's fit is near numpy's minimum on what the fold doesn't hold; cases are what the best penalties answer."""
    g = grid.wide_gaps(spark, DIR).cache()
    rows = g.collect()
    fits = grid.grid(g)
    names = {x.dataset for x in rows}
    assert len(fits) == len(names) * (grid.FOLDS + 1) * 27
    for d, k, *x, w, v in fits[:: max(1, len(fits) // 25)]:
        use = [y for y in rows if y.dataset == d and k not in y.held]
        if not use:
            continue
        gap, c1, c2 = (np.array([y[c] for y in use], float) for c in ("gap", "c1", "c2"))
        half = 4 + (gap.shape[1] - 4) // 2
        penalty = np.repeat(x, [4, half - 4, gap.shape[1] - half])
        cost, grad = descent.sums(gap, c1, c2, np.ones((len(use), 1)), np.array([w]))
        grad, w = grad[0] + penalty, np.array(w)
        assert abs(cost[0] + penalty @ w - v) < 1e-6 * (1 + abs(v))
        assert np.abs(np.maximum(w - grad, descent.LOWEST) - w).max() < 1e-5 * (1 + abs(v))
    tested = grid.judged(g, fits).collect()
    by = {(d, k, *x): np.array(w) for d, k, *x, w, _ in fits}
    for y in tested[::97]:
        gap = next(z.gap for z in rows if z.t == y.t)
        margin = float(by[y.dataset, y.fold, y.l_own, y.l_low, y.l_high] @ gap)
        assert abs(margin - y.margin) < 1e-6 and (abs(margin) < 1e-8 or y.right == (margin > 0))


def test_queries_agree(spark):
    whole, cases = grid.learn_grid(spark, DIR).collect(), grid.learn_cases(spark, DIR).collect()
    for d in {x.dataset for x in whole}:
        of = [x for x in whole if x.dataset == d]
        best = [x for x in of if x.best]
        assert len(of) == 27 and len(best) == 1 and best[0].n_right == max(x.n_right for x in of) == sum(c.right for c in cases if c.dataset == d)
        assert best[0].n == sum(c.dataset == d for c in cases)
        assert all(abs(x.share_own + x.share_low + x.share_high - 1) < 0.01 or max(x.w) < 1e-3 for x in of)
