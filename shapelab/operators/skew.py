"""Joins whose keys may be very uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task gets, at least; and most keys that can have more than their share.
LEAST, KEYS = 256, 10_000


def hot_keys(many: DataFrame, on: str) -> DataFrame | None:
    """(on, parts): keys with more than max(LEAST, rows / KEYS) rows and in how many parts they go; None if there are none.

    Fewer than KEYS keys can have so many rows, whatever the table's size, so that the result can be broadcast.
    Counts are combined before they are shuffled. `many` is read twice: let it be a table or a checkpoint."""
    rows = many.count()
    if rows <= LEAST:
        return None
    return hot_of(many.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("n")), on, rows)


def hot_of(counts: DataFrame, on: str, rows: int) -> DataFrame | None:
    """The same from counts (on, n) of a table of so many rows."""
    most = max(LEAST, rows // KEYS)
    hot = counts.where(F.col("n") > most).select(on, F.ceil(F.col("n") / most).cast("int").alias("_parts")).collect()  # fewer than KEYS rows
    return counts.sparkSession.createDataFrame([tuple(r) for r in hot], counts.select(on, F.lit(0).alias("_parts")).schema) if hot else None


def spread_join(many: DataFrame, one: DataFrame, on: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """`many` joined with `one` by `on`; a key that is in `hot` is dealt over several tasks.

    `one` should have few rows per key: those of a hot key are sent once to each of its parts. `how` is inner or left."""
    if hot is None:
        return many.join(one, on, how)
    hot = F.broadcast(hot)
    cols = [c for c in many.columns if c != on]
    left = many.join(hot, on, "left").withColumn("_part", F.when(F.col("_parts") > 1, F.pmod(F.xxhash64(*cols), F.col("_parts"))).otherwise(F.lit(0))).drop("_parts")
    right = one.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts"), F.lit(1)).cast("long") - 1))).drop("_parts")
    return left.withColumn("_part", F.col("_part").cast("long")).join(right, [on, "_part"], how).drop("_part")
