"""New rows as they arrive: histograms and boxes of shapes by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_boxes(points: DataFrame, time: str = "ts", width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """A streaming table of points (ts, shape_id, x, y, z) to boxes per shape and window; rows later than `late` don't count."""
    ends = [f(c).alias(f"{c}{i}") for c in "xyz" for i, f in enumerate((F.min, F.max))]
    w = points.withWatermark(time, late).groupBy(F.window(time, width), "shape_id").agg(F.count(F.lit(1)).alias("n"), *ends)
    return w.select(F.col("window.start").alias("start"), "shape_id", "n", *[f"{c}{i}" for c in "xyz" for i in (0, 1)])


def each_batch(stream: DataFrame, stage, out: str, checkpoint: str):  # noqa: ANN001, ANN201
    """Runs a batch stage on what has arrived and appends its rows; a batch is written once under its id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
