"""Exact ranks and quantiles that don't sort a group in one task.

Equal values are counted before they are shuffled, once, and kept. A group's distinct values are dealt into bins between
its approximate quantiles, so that outliers don't gather the others in one bin; running counts are taken over the bins
(a fixed number per group) and inside each bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapelab.session import cut

#: Quantiles of a group, and bins of even width between two of them.
QUANTILES, BINS = 64, 256
#: Rows of a group up to which a task adds them up in order; groups that are sent to every task, at most.
FEW, SENT = 4096, 10_000


def running(df: DataFrame, keys: list[str], order: str, weight: str) -> DataFrame:
    """Adds `before` and `total`: sums of `weight` over the rows of the keys with a smaller `order`, and over all. `order` is unique within the keys.

    Groups of FEW rows or fewer are added up in order; only larger ones get quantiles and bins, whose marks would be many times such a small group.
    df is read several times: let it be a table or a checkpoint."""
    if keys:
        large = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW).select(*keys))
        n = large.count()
        if not n:
            return _in_order(df, keys, order, weight)
        large = F.broadcast(large) if n <= SENT else large
        small = _in_order(df.join(large, keys, "left_anti"), keys, order, weight)
        return small.unionByName(_in_bins(df.join(large, keys, "left_semi"), keys, order, weight))
    return _in_bins(df, keys, order, weight)


def _in_order(df: DataFrame, keys: list[str], order: str, weight: str) -> DataFrame:
    by = Window.partitionBy(*keys)
    return df.withColumn("before", F.sum(weight).over(by.orderBy(order)) - F.col(weight)).withColumn("total", F.sum(weight).over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def _in_bins(df: DataFrame, keys: list[str], order: str, weight: str) -> DataFrame:
    at = F.col(order).cast("double")
    marks = F.percentile_approx(at, F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)]), F.lit(1000))
    ends = df.groupBy(*keys).agg(marks.alias("_marks"), F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.sum(weight).alias("total"))
    # the ends of the approximate quantiles may lie inside of the range
    ends = ends.withColumn("_marks", F.concat(F.array("_lo"), F.slice("_marks", 2, QUANTILES - 1), F.array("_hi"))).drop("_lo", "_hi")
    d = df.join(ends, keys) if keys else df.crossJoin(F.broadcast(ends))  # one row
    d = d.withColumn("_k", F.least(F.greatest(F.size(F.filter("_marks", lambda m: m <= at)), F.lit(1)), F.lit(QUANTILES)))
    lo, hi = F.get("_marks", F.col("_k") - 1), F.get("_marks", F.col("_k"))
    place = F.when(hi > lo, F.least(F.greatest(F.floor((at - lo) / (hi - lo) * BINS), F.lit(0)), F.lit(BINS - 1))).otherwise(0)
    d = d.withColumn("_bin", (F.col("_k") * BINS + place).cast("int")).drop("_marks", "_k")
    cells = d.groupBy(*keys, "_bin").agg(F.sum(weight).alias("_m"))
    cells = cells.withColumn("_outer", F.sum("_m").over(Window.partitionBy(*keys).orderBy("_bin")) - F.col("_m")).drop("_m")
    inner = F.sum(weight).over(Window.partitionBy(*keys, "_bin").orderBy(order)) - F.col(weight)
    d = d.withColumn("_inner", inner).join(cells, [*keys, "_bin"])
    return d.withColumn("before", F.col("_outer") + F.col("_inner")).drop("_outer", "_inner", "_bin")


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, before, total): each distinct value holds the 0-based ranks before .. before + n - 1."""
    return running(cut(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))), keys, value, "n")


def nth(df: DataFrame, keys: list[str], value: str, at: Column, name: str) -> DataFrame:
    """The value at the 0-based rank `at`, an expression of `total`, of each group."""
    r = value_ranks(df, keys, value)
    return r.where((F.col("before") <= at) & (at < F.col("before") + F.col("n"))).select(*keys, F.col(value).alias(name))


def nth_quantile(df: DataFrame, keys: list[str], value: str, p: float, name: str = "q") -> DataFrame:
    """The element at rank floor(n p), without interpolation."""
    return nth(df, keys, value, F.floor(F.col("total") * p), name)


def upper_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    return nth_quantile(df, keys, value, 0.5, name)


def hazen(df: DataFrame, keys: list[str], value: str, p: float, name: str = "q") -> DataFrame:
    """Quantile by midpoint interpolation: position n p + 1/2 (from 1), clamped to 1..n, linear in between."""
    h = F.greatest(F.least(F.col("total") * p + 0.5, F.col("total").cast("double")), F.lit(1.0))
    lo, hi = F.floor(h) - 1, F.ceil(h) - 1
    r = value_ranks(df, keys, value)
    holds = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("n"))
    picked = r.where(holds(lo) | holds(hi)).groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"), F.first("total").alias("total"))
    return picked.select(*keys, (F.col("_a") + (h - F.floor(h)) * (F.col("_b") - F.col("_a"))).alias(name))
