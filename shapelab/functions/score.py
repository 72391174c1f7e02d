"""Scores: clamped sigmoid, scaling, curvature metrics, energies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)), kept inside [1e-6, 1 - 1e-6]."""
    return F.greatest(F.least(1 / (1 + F.exp(-x)), F.lit(1 - 1e-6)), F.lit(1e-6))


def scaled(x: Column, scale: Column) -> Column:
    """min(x / scale, 1); a scale of 0 counts as 1."""
    return F.least(x / F.when(scale == 0, 1.0).otherwise(scale), F.lit(1.0))


def axis_stretch(s: Column) -> Column:
    """max(|s|, 1 / max(0.01, |s|)) - 1."""
    return F.greatest(F.abs(s), 1 / F.greatest(F.lit(0.01), F.abs(s))) - 1


# Fixed order of the thirteen curvature metrics.
CURVATURE = ("max_value", "min_value", "max_magnitude", "min_magnitude", "mean", "gaussian", "abs_max_value", "abs_min_value", "abs_max_magnitude", "abs_min_magnitude", "abs_mean", "abs_gaussian", "mean_magnitude")


def curvature_metrics(k1: Column, k2: Column, unit_range: bool = False) -> dict[str, Column]:
    """Principal curvatures in [-1, 1] to thirteen metrics; unit_range shifts the signed ones into [0, 1]."""
    larger = F.abs(k1) > F.abs(k2)
    big, small = F.when(larger, k1).otherwise(k2), F.when(larger, k2).otherwise(k1)
    signed = [k1, k2, big, small, (k1 + k2) / 2, k1 * k2]
    if unit_range:
        signed = [(x + 1) / 2 for x in signed]
    plain = [F.abs(k1), F.abs(k2), F.abs(big), F.abs(small), F.abs(k1 + k2) / 2, F.abs(k1 * k2), (F.abs(k1) + F.abs(k2)) / 2]
    return dict(zip(CURVATURE, signed + plain))


def energy_terms(distance: Column, sigma: float) -> tuple[Column, Column]:
    """(cost of taking a patch, cost of leaving it) for a distance."""
    taken = distance / sigma
    return taken, F.greatest(F.lit(0.0), -F.log(1 - F.exp(-taken) + 1e-5))


def log_normal(v: Column, lo: Column, hi: Column, alpha: float = 4.0) -> Column:
    """log(alpha v' + 1) / log(alpha + 1) for v' from 0 to 1 between lo and hi; 1 where all values are equal; an exact 0 stays 0."""
    unit = (v - lo) / (hi - lo)
    return F.when(hi == lo, 1.0).when(v == 0, 0.0).otherwise(F.log(unit * alpha + 1) / F.log(F.lit(alpha + 1)))
