"""Bounded fits of many weights under many penalties and folds, all from one table of rows.

A projected L-BFGS runs per problem on the driver, which holds its weights and the last MEMORY steps, and nothing of the
rows. A problem is a dataset, a fold and a penalty; all problems of a dataset read the same rows, so that a step of all
of them is one pass: tasks multiply blocks of rows by the weights of every open problem, and send back one cost and
one gradient per problem, summed by blocks of problems. No problem waits for another: each has its own trial point."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LOWEST = 1e-30
MEMORY, HALVINGS = 12, 40
#: Rows that are multiplied at once, and problems whose sums are added up by one group.
ROWS, BLOCK = 2048, 8


@dataclass(frozen=True)
class Problem:
    """Rows of `dataset` that don't hold `fold` out (None: all), and a penalty on each weight."""

    dataset: str
    fold: int | None
    penalty: tuple[float, ...]


def sums(gap: np.ndarray, c1: np.ndarray, c2: np.ndarray, counts: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cost and gradient by problem, without penalties: sum over rows of -c1 log p - c2 log(1 - p), p = sigmoid(gap . w).

    gap: rows x weights; counts: rows x problems, 1 where the row counts; w: problems x weights."""
    z = gap @ w.T
    cost = (counts * (c1[:, None] * np.logaddexp(0, -z) + c2[:, None] * np.logaddexp(0, z))).sum(0)
    p = np.exp(-np.logaddexp(0, -z))
    return cost, (counts * ((p - 1) * c1[:, None] + p * c2[:, None])).T @ gap


def evaluated(rows: DataFrame, problems: list[Problem], at: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
    """Cost and gradient of each problem (by its place in the list) at its weights, in one job.

    rows: dataset, gap (array), c1, c2, held (the folds that hold the row out)."""
    by: dict[str, list[int]] = {}
    for i in at:
        by.setdefault(problems[i].dataset, []).append(i)
    stacked = {d: (ids, np.stack([at[i] for i in ids]), [problems[i].fold for i in ids]) for d, ids in by.items()}
    width = len(next(iter(at.values())))

    def partials(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for part in parts:
            for name, rows_ in part.groupby("dataset"):
                if name not in stacked:
                    continue
                ids, w, folds = stacked[name]
                for k in range(0, len(rows_), ROWS):
                    r = rows_.iloc[k : k + ROWS]
                    held = [set(h) for h in r["held"]]
                    out_of = {f: np.array([f not in h for h in held], float) for f in set(folds)}
                    cost, grad = sums(np.stack(r["gap"].to_numpy()), r["c1"].to_numpy(), r["c2"].to_numpy(), np.stack([out_of[f] for f in folds], 1), w)
                    total[name] = total.get(name, 0) + np.column_stack([cost, grad])
        found = [(i, v) for name, x in total.items() for i, v in zip(stacked[name][0], x)]
        blocks: dict[int, list] = {}
        for i, v in found:
            blocks.setdefault(i // BLOCK, []).append((i, v))
        yield pd.DataFrame([(b, [i for i, _ in x], np.concatenate([v for _, v in x])) for b, x in blocks.items()], columns=["block", "ids", "v"])

    def added(part: pd.DataFrame) -> pd.DataFrame:
        total: dict[int, np.ndarray] = {}
        for ids, v in zip(part["ids"], part["v"]):
            for i, x in zip(ids, np.asarray(v).reshape(len(ids), -1)):
                total[i] = total.get(i, 0) + x
        return pd.DataFrame({"i": list(total), "v": list(total.values())})

    parts = rows.select("dataset", "gap", "c1", "c2", "held").mapInPandas(partials, "block int, ids array<int>, v array<double>")
    got = {r.i: np.array(r.v) for r in parts.groupBy("block").applyInPandas(added, "i int, v array<double>").collect()}  # a row per problem
    none = np.zeros(1 + width)
    return {i: (float(got.get(i, none)[0]), got.get(i, none)[1:]) for i in at}


@dataclass
class Descent:
    """One problem's way down: `trial` is where it wants to be evaluated next, None once it is done."""

    penalty: np.ndarray
    w: np.ndarray
    low: np.ndarray
    settle: float
    cost: float = np.inf
    grad: np.ndarray | None = None
    direction: np.ndarray | None = None
    size: float = 1.0
    halved: int = 0
    steps: list = field(default_factory=list)
    trial: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.trial = self.w

    def _turn(self) -> None:
        """A new direction on the weights that aren't held at their bound."""
        g = self.grad
        if np.abs(np.maximum(self.w - g, self.low) - self.w).max() <= self.settle * (1 + abs(self.cost)):
            self.trial = None
            return
        free = (self.w > self.low + 1e-12) | (g < 0)
        d, kept = np.where(free, g, 0.0), []
        for s, y in reversed(self.steps):
            s, y = np.where(free, s, 0.0), np.where(free, y, 0.0)
            if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
                a = (s @ d) / (s @ y)
                d = d - a * y
                kept.append((s, y, a))
        if kept:
            s, y, _ = kept[0]
            d = d * (s @ y) / (y @ y)
        else:
            d = d / max(1.0, np.abs(d).max())
        for s, y, a in reversed(kept):
            d = d + s * (a - (y @ d) / (s @ y))
        d = -np.where(free, d, 0.0)
        if d @ g >= 0:
            self.steps, d = [], -np.where(free, g, 0.0) / max(1.0, np.abs(g).max())
        self.direction, self.size, self.halved = d, 1.0, 0
        self.trial = np.maximum(self.w + d, self.low)

    def told(self, cost: float, grad: np.ndarray) -> None:
        """Cost and gradient at the trial, without the penalty."""
        cost, grad = cost + float(self.penalty @ self.trial), grad + self.penalty
        if self.grad is None:
            self.cost, self.grad = cost, grad
            self._turn()
            return
        moved = self.trial - self.w
        if cost <= self.cost + 1e-4 * float(self.grad @ moved):
            self.steps = [*self.steps, (moved, grad - self.grad)][-MEMORY:]
            self.w, self.cost, self.grad = self.trial, cost, grad
            self._turn()
            return
        self.size, self.halved = self.size / 2, self.halved + 1
        if self.halved > HALVINGS:
            if not self.steps:
                self.trial = None  # nothing falls any more
                return
            self.steps = []
            self._turn()
            return
        self.trial = np.maximum(self.w + self.size * self.direction, self.low)


def minimise(rows: DataFrame, problems: list[Problem], start: list[float], low: list[float] | None = None, settle: float = 1e-8, passes: int = 400) -> list[tuple[np.ndarray, float]]:
    """Weights of at least `low` (LOWEST each) with the smallest cost plus penalty of every problem, and that minimum.

    rows as for `evaluated`; let it be a table or a checkpoint. A problem is done when the projected gradient is at most
    `settle` of its cost; an error says so if some aren't after `passes` over the rows. A problem without rows goes
    to its bounds where its penalties aren't zero."""
    first, bound = np.array(start, float), np.full(len(start), LOWEST) if low is None else np.array(low, float)
    ways = [Descent(np.array(p.penalty, float), np.maximum(first, bound), bound, settle) for p in problems]
    for _ in range(passes):
        at = {i: x.trial for i, x in enumerate(ways) if x.trial is not None}
        if not at:
            return [(x.w, x.cost) for x in ways]
        for i, (cost, grad) in evaluated(rows, problems, at).items():
            ways[i].told(cost, grad)
    raise RuntimeError(f"{sum(x.trial is not None for x in ways)} fits are unsettled after {passes} passes")
