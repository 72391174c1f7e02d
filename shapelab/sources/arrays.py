"""Matrices, vectors and ragged int arrays: binary and text files, decoded in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _decode(spark: SparkSession, path: str, schema: str, one) -> DataFrame:  # noqa: ANN001
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"]):
                out = one(data)
                out.insert(0, "path", name)
                yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, {schema}")


def read_matrix(spark: SparkSession, path: str, clean: bool = False) -> DataFrame:
    """(path, row, v): int32 rows, int32 columns, then doubles by row. clean: values that aren't finite become 0."""

    def one(data: bytes) -> pd.DataFrame:
        n, m = np.frombuffer(data, "<i4", 2)
        v = np.frombuffer(data, "<f8", n * m, 8).reshape(n, m)
        return pd.DataFrame({"row": np.arange(n, dtype=np.int32), "v": list(np.where(np.isfinite(v), v, 0) if clean else v)})

    return _decode(spark, path, "row int, v array<double>", one)


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, v): int32 length, then doubles."""

    def one(data: bytes) -> pd.DataFrame:
        n = int(np.frombuffer(data, "<i4", 1)[0])
        return pd.DataFrame({"at": np.arange(n, dtype=np.int32), "v": np.frombuffer(data, "<f8", n, 4).astype(float)})

    return _decode(spark, path, "at int, v double", one)


def read_feature(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, v): doubles without a header."""
    return _decode(spark, path, "at int, v double", lambda data: pd.DataFrame({"at": np.arange(len(data) // 8, dtype=np.int32), "v": np.frombuffer(data, "<f8", len(data) // 8).astype(float)}))


def read_ragged(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, ids): int32 rows; each an int32 length and as many int32."""

    def one(data: bytes) -> pd.DataFrame:
        x = np.frombuffer(data, "<i4", len(data) // 4)
        rows, at = [], 1
        for _ in range(int(x[0]) if len(x) else 0):
            rows.append(x[at + 1 : at + 1 + x[at]].astype(np.int32))
            at += 1 + int(x[at])
        return pd.DataFrame({"row": np.arange(len(rows), dtype=np.int32), "ids": rows})

    return _decode(spark, path, "row int, ids array<int>", one)


def matrix_bytes(v: np.ndarray) -> bytes:
    return np.array(v.shape, "<i4").tobytes() + np.ascontiguousarray(v, "<f8").tobytes()


def read_text_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, v) of numbers between white space, a row a line; rows of different lengths are an error."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n")).alias("row", "line"))
    v = lines.select("path", "row", F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double")).alias("v"))
    width = v.groupBy("path").agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi"))
    return v.join(width, "path").withColumn("v", F.when(F.col("lo") == F.col("hi"), F.col("v")).otherwise(F.raise_error(F.concat(F.lit("rows differ in length: "), F.col("path"))))).select("path", "row", "v")


def read_segments(spark: SparkSession, path: str, least: int = 20) -> DataFrame:
    """(path, segment_id, pos, point_id) of a text: the number of segments, then `n id ...` a line; small ones are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n")).alias("at", "line")).where("at > 0")
    ids = lines.select("path", (F.col("at") - 1).alias("segment_id"), F.split(F.trim("line"), r"\s+").alias("x")).where(F.size("x") - 1 >= least)
    return ids.select("path", "segment_id", F.posexplode(F.slice("x", F.lit(2), F.size("x") - 1)).alias("pos", "id")).select("path", "segment_id", "pos", F.col("id").cast("int").alias("point_id"))
