"""Set operators: pairs, complements, separations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_pairs(df: DataFrame, u: str, v: str) -> DataFrame:
    """Unordered pairs once, smaller end first; loops and null ends are left out."""
    return df.where(F.col(u) != F.col(v)).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()


def both_directions(df: DataFrame, u: str, v: str, *keep: str) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col(u).alias("src"), F.col(v).alias("dst")), F.struct(F.col(v).alias("src"), F.col(u).alias("dst"))))
    return df.select(ends.alias("e"), *keep).select("e.src", "e.dst", *keep)


def union_roles(forward: DataFrame, backward: DataFrame, source: str, target: str) -> DataFrame:
    """Both directions' rows together; the backward ones' roles are swapped."""
    swapped = backward.withColumn("_t", F.col(source)).withColumn(source, F.col(target)).withColumn(target, F.col("_t")).drop("_t")
    return forward.unionByName(swapped)


def complement(everything: DataFrame, taken: DataFrame, on: list[str]) -> DataFrame:
    """Rows of everything that are not taken."""
    return everything.join(taken.select(*on).distinct(), on, "left_anti")


def covered(members: DataFrame, group: list[str], hit: Column, share: float) -> DataFrame:
    """Groups of whose members at least `share` are hit."""
    counts = members.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(hit, 1).otherwise(0)).alias("n_hit"))
    return counts.where(F.col("n_hit") >= share * F.col("n"))


def separated(train: DataFrame, test: DataFrame) -> DataFrame:
    """Training triplets (a, b, c) that share no unordered pair (a, b) or (a, c) with a test triplet."""
    def pairs(df: DataFrame) -> DataFrame:
        e = F.explode(F.array(F.struct(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")), F.struct(F.least("a", "c").alias("u"), F.greatest("a", "c").alias("v"))))
        return df.select(e.alias("e")).select("e.u", "e.v").distinct()

    p = pairs(test)
    for end in ("b", "c"):
        t = train.withColumn("_u", F.least("a", end)).withColumn("_v", F.greatest("a", end))
        train = t.join(p.select(F.col("u").alias("_u"), F.col("v").alias("_v")), ["_u", "_v"], "left_anti").drop("_u", "_v")
    return train
