"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def builder(master: str = "local[8]", partitions: int = 8) -> SparkSession.Builder:
    """A local session for tests and the benchmark; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(master)
        .appName("shapelab")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "6g")
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session that names none gets one of its own (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-shapelab-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: computes `df` once into the shared checkpoint folder and reads it from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage too, but by a Parquet table in that folder, which is computed once where a checkpoint is computed twice."""
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/shapelab-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # without a job that looks for the schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
