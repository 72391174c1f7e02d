"""Bounded maximum-a-posteriori fits of many small problems at once.

Every step is one aggregate over all rows by problem; the driver holds a handful of weights per problem."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelab.functions import score, vec

LOWEST = 1e-30


def _sums(rows: DataFrame, weights: dict[str, np.ndarray]) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """By problem the cost without the penalty, its gradient and its Hessian."""
    k = len(next(iter(weights.values())))
    w = F.broadcast(rows.sparkSession.createDataFrame([(p, [float(x) for x in v]) for p, v in weights.items()], "problem string, w array<double>"))  # a row per problem
    p = score.sigmoid(vec.dot(F.col("w"), F.col("gap")))
    r = rows.join(w, "problem").withColumn("p", p)
    g = [F.col("gap")[i] for i in range(k)]
    pull, curve = (F.col("p") - 1) * F.col("c1") + F.col("p") * F.col("c2"), (F.col("c1") + F.col("c2")) * F.col("p") * (1 - F.col("p"))
    cost = F.sum(-F.col("c1") * F.log("p") - F.col("c2") * F.log(1 - F.col("p")))
    found = r.groupBy("problem").agg(cost, *[F.sum(pull * x) for x in g], *[F.sum(curve * g[i] * g[j]) for i in range(k) for j in range(i, k)]).collect()
    out = {}
    for row in found:
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = row[2 + k :]
        out[row[0]] = (row[1], np.array(row[2 : 2 + k], float), h + np.triu(h, 1).T)
    return out


def fit(rows: DataFrame, penalty: dict[str, float], width: int, steps: int = 100, settle: float = 1e-9) -> dict[str, tuple[np.ndarray, float]]:
    """Weights of at least LOWEST that minimise sum(-c1 log p - c2 log(1 - p)) + penalty * sum(w), p = sigmoid(w . gap), and that minimum.

    rows: problem, gap (array), c1, c2; let it be a table or a checkpoint. Newton steps on the weights that aren't held
    at the bound, halved until the cost falls; a problem is done when its step changes next to nothing. Problems without
    rows keep weights of one."""
    w = {p: np.ones(width) for p in penalty}
    value = lambda s, p, v: s[p][0] + penalty[p] * v.sum()
    now = _sums(rows, w) if w else {}
    open_ = set(now)
    for _ in range(steps):
        if not open_:
            break
        step: dict[str, np.ndarray] = {}
        for p in open_:
            grad = now[p][1] + penalty[p]
            free = (w[p] > 2 * LOWEST) | (grad < 0)
            d = np.zeros(width)
            if free.any():
                h = now[p][2][np.ix_(free, free)]
                d[free] = -np.linalg.solve(h + 1e-9 * (1 + np.trace(h)) * np.eye(int(free.sum())), grad[free])
            step[p] = d
        size, left = dict.fromkeys(open_, 1.0), set(open_)
        for _ in range(40):
            trial = {p: np.maximum(w[p] + size[p] * step[p], LOWEST) for p in left}
            then = _sums(rows.where(F.col("problem").isin(sorted(left))), trial)
            for p in sorted(left):
                old = value(now, p, w[p])
                if value(then, p, trial[p]) <= old + 1e-12 * abs(old):
                    if old - value(then, p, trial[p]) <= settle * (1 + abs(old)):
                        open_.discard(p)
                    w[p], now[p] = trial[p], then[p]
                    left.discard(p)
                else:
                    size[p] /= 2
            if not left:
                break
        open_ -= left  # no step falls any more
    return {p: (w[p], float(value(now, p, w[p])) if p in now else 0.0) for p in w}
