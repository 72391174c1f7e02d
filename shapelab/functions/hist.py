"""Histograms and earth mover's distances as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Deviation of the smoothing, in bins; values further than three of them give a bin nothing.
SIGMA = 2.0


def _place(value: str, bins: int | Column, lo: float, hi: float):  # noqa: ANN202
    return (F.col(value) - lo) / (hi - lo) * bins


def histogram(df: DataFrame, keys: list[str], value: str, bins: int | Column = 32, lo: float = 0.0, hi: float = 1.0, smooth: bool = True, weight: str | None = None) -> DataFrame:
    """(keys, bin, p): a normalised histogram per group with a row for every bin.

    Equal values are counted first, so smoothing spreads distinct values alone; weight names a column of counts; bins may be one of the keys. lo = hi gives the uniform histogram; nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    groups = df.select(*keys).distinct()
    every = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    if lo == hi:
        return every.withColumn("p", F.lit(1.0 / bins))
    at = _place(value, bins, lo, hi)
    if smooth:
        cut0 = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("int")
        first, last = F.greatest(F.lit(0), cut0(at - 3 * SIGMA)), F.least(F.lit(bins - 1), cut0(at + 3 * SIGMA))
        spread = counts.withColumn("at", at).where(first <= last).withColumn("bin", F.explode(F.sequence(first, last)))
        weight = F.col("n") * F.exp(-(F.col("at") - F.col("bin") - 0.5) * (F.col("at") - F.col("bin") - 0.5) / (2 * SIGMA * SIGMA))
    else:
        spread = counts.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), at.cast("int"))))
        weight = F.col("n").cast("double")
    w = spread.groupBy(*keys, "bin").agg(F.sum(weight).alias("w"))
    total = w.groupBy(*keys).agg(F.sum("w").alias("total"))
    w = w.join(total, keys) if keys else w.crossJoin(F.broadcast(total))
    out = every.join(w, [*keys, "bin"], "left")
    has = every.select(*keys).distinct().join(total.select(*keys).withColumn("some", F.lit(True)), keys, "left") if keys else None
    out = out.join(has, keys) if has is not None else out.withColumn("some", F.lit(True))
    return out.select(*keys, "bin", F.when(F.col("some"), F.coalesce(F.col("w") / F.col("total"), F.lit(0.0))).otherwise(1.0 / bins).alias("p"))


def cumulative(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `cdf`; a group has as many rows as bins."""
    return hist.withColumn("cdf", F.sum("p").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))


def emd(hist: DataFrame, key: str, extra: list[str] | None = None) -> DataFrame:
    """(a, b, emd) for every two groups a < b: the sum over bins of the difference of their cumulative sums."""
    extra = extra or []
    c = cumulative(hist, [key, *extra])
    x = c.select(F.col(key).alias("a"), *extra, "bin", F.col("cdf").alias("x"))
    y = c.select(F.col(key).alias("b"), *extra, "bin", F.col("cdf").alias("y"))
    return x.join(y, [*extra, "bin"]).where("a < b").groupBy("a", "b", *extra).agg(F.sum(F.abs(F.col("x") - F.col("y"))).alias("emd"))
