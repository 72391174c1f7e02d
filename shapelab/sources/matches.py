"""Files of the matching and learning stages: triplets, patches, votes, alignments, modes, elements, features and weights.

Text files are split and parsed by column expressions, a row per line; binary records are decoded file by file in tasks.
`<pair>` is the folder of two shapes, src--tgt."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import _decode, read_matrix, read_ragged, read_vector
from .ply import read_vertices

CURVATURE = np.dtype([("k1", "<f4"), ("k2", "<f4"), ("d1", "<f4", 3), ("d2", "<f4", 3)])
CURVES = ("ridge", "valley", "boundary", "mixed")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, part): the words of every line, from 0."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n")).alias("at", "line"))
    return text.select("path", "at", F.filter(F.split("line", r"\s+"), lambda x: x != "").alias("part"))


def _numbers(c: Column) -> Column:
    return F.transform(c, lambda x: x.try_cast("double"))


def _finite(c: Column) -> Column:
    """Whether all of an array are numbers, and finite."""
    return F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    """(triplet_id, a, b, c): three names a line; another number of them is an error. Ids from 1, by line."""
    t = _lines(spark, path).where(F.size("part") > 0)
    ok = F.when(F.size("part") == 3, F.col("part")).otherwise(F.raise_error(F.concat(F.lit("not a triplet: "), F.array_join("part", " "))))
    return t.select((F.col("at") + 1).alias("triplet_id"), ok.alias("p")).select("triplet_id", *[F.col("p")[i].alias(c) for i, c in enumerate("abc")])


def read_curvature(spark: SparkSession, path: str) -> DataFrame:
    """(path, point_id, k1, k2, d1, d2): an int32 count, then records of eight floats."""

    def one(data: bytes) -> pd.DataFrame:
        n = int(np.frombuffer(data, "<i4", 1)[0])
        x = np.frombuffer(data, CURVATURE, n, 4)
        return pd.DataFrame({"point_id": np.arange(n, dtype=np.int32), "k1": x["k1"].astype("f4"), "k2": x["k2"].astype("f4"), "d1": list(x["d1"].astype("f4")), "d2": list(x["d2"].astype("f4"))})

    return _decode(spark, path, "point_id int, k1 float, k2 float, d1 array<float>, d2 array<float>", one)


def read_saliency(spark: SparkSession, path: str) -> DataFrame:
    """(path, point_id, d_low, a_low, d_high): three doubles a point without a header."""

    def one(data: bytes) -> pd.DataFrame:
        x = np.frombuffer(data, "<f8", len(data) // 24 * 3).reshape(-1, 3).astype(float)
        return pd.DataFrame({"point_id": np.arange(len(x), dtype=np.int32), "d_low": x[:, 0], "a_low": x[:, 1], "d_high": x[:, 2]})

    return _decode(spark, path, "point_id int, d_low double, a_low double, d_high double", one)


def read_patches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, patch_id, pos, point_id) and (path, patch_id, neighbour): the number P of patches, P lines `n id ...`, P lines `k neighbour ...`."""
    t = _lines(spark, path)
    p = t.where("at = 0").select("path", F.col("part")[0].cast("int").alias("P"))
    rest = t.where("at > 0").join(p, "path").withColumn("ids", F.transform(F.slice("part", 2, F.greatest(F.size("part") - 1, F.lit(0))), lambda x: x.cast("int")))
    first = rest.where("at <= P").select("path", (F.col("at") - 1).alias("patch_id"), F.posexplode("ids").alias("pos", "point_id"))
    second = rest.where("at > P and at <= 2 * P").select("path", (F.col("at") - F.col("P") - 1).alias("patch_id"), F.explode("ids").alias("neighbour"))
    return first, second


def _affines(t: DataFrame, first: int, head: int) -> DataFrame:
    """(path, id, part, affine) of blocks of `head` lines and three lines of four numbers, which begin at line `first`."""
    each = head + 3
    b = t.where(F.col("at") >= first).withColumn("id", F.floor((F.col("at") - first) / each).cast("int")).withColumn("of", (F.col("at") - first) % each)
    rows = b.groupBy("path", "id").agg(F.max(F.when(F.col("of") == 0, F.col("part"))).alias("part"), F.array_sort(F.collect_list(F.when(F.col("of") >= head, F.struct("of", "part")))).alias("m"))  # three lines each
    return rows.select("path", "id", "part", _numbers(F.flatten(F.col("m.part"))).alias("affine"))


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """(path, vote_id, src_seg, tgt_seg, weight, affine): the number of votes; per vote a line `src tgt weight` and three lines of four. Votes that aren't finite are left out."""
    v = _affines(_lines(spark, path), 1, 1)
    v = v.select("path", F.col("id").alias("vote_id"), F.col("part")[0].try_cast("int").alias("src_seg"), F.col("part")[1].try_cast("int").alias("tgt_seg"), F.col("part")[2].try_cast("double").alias("weight"), "affine")
    return v.where(_finite(F.array("weight")) & _finite(F.col("affine")) & (F.size("affine") == 12))


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """(path, affine, distances): three lines of four numbers, then distances. A value that isn't finite is an error."""
    t = _lines(spark, path)
    g = t.groupBy("path").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])).alias("x"))  # a file of a few dozen numbers
    n = _numbers(F.col("x"))
    g = g.withColumn("n", F.when(_finite(n), n).otherwise(F.raise_error(F.concat(F.lit("not finite: "), F.col("path")))))
    return g.select("path", F.slice("n", 1, 12).alias("affine"), F.slice("n", F.lit(13), F.greatest(F.size("n") - 12, F.lit(0))).alias("distances"))


def read_modes(spark: SparkSession, path: str) -> DataFrame:
    """(path, mode_id, sigma, affine): a line `M sigma`, then three lines of four numbers a mode."""
    t = _lines(spark, path)
    sigma = t.where("at = 0").select("path", F.col("part")[1].cast("double").alias("sigma"))
    return _affines(t, 1, 0).select("path", F.col("id").alias("mode_id"), "affine").join(sigma, "path").select("path", "mode_id", "sigma", "affine")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(path, element_id, mode_id, side, patch_id): the number of elements; per element its mode and a line `n patch ...` for the source and the target."""
    t = _lines(spark, path).where("at > 0").withColumn("element_id", F.floor((F.col("at") - 1) / 3).cast("int")).withColumn("of", (F.col("at") - 1) % 3)
    mode = t.where("of = 0").select("path", "element_id", F.col("part")[0].cast("int").alias("mode_id"))
    ids = t.where("of > 0").select("path", "element_id", F.when(F.col("of") == 1, "source").otherwise("target").alias("side"), F.explode(F.slice("part", 2, F.greatest(F.size("part") - 1, F.lit(0)))).alias("patch"))
    return ids.join(mode, ["path", "element_id"]).select("path", "element_id", "mode_id", "side", F.col("patch").cast("int").alias("patch_id"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, value): a number a line."""
    return _lines(spark, path).where(F.size("part") > 0).select("path", "at", F.col("part")[0].cast("double").alias("value"))


def read_curves(spark: SparkSession, folder: str) -> DataFrame:
    """(path, curve_type, vertex_id, x .. nz) of a shape's four curve files curve-0.ply to curve-3.ply."""
    v = read_vertices(spark, f"{folder}/curve-*.ply")
    kind = F.regexp_extract("path", r"curve-([0-3])\.ply$", 1).cast("int")
    return v.withColumn("curve_type", F.get(F.array(*map(F.lit, CURVES)), kind)).where("curve_type is not null")


def with_features(points: DataFrame, *features: DataFrame) -> DataFrame:
    """Points with what feature tables say of (shape_id, point_id); a point that one doesn't have keeps nulls there."""
    for f in features:
        points = points.join(f, ["shape_id", "point_id"], "left")
    return points


def learning_set(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The files triplet/<id>/<kind>{AB,AC}<sigma>.txt as tables by kind, with triplet_id, pair and sigma from their paths.

    pd: element distances, sd: shape distances, as / at: points of elements, us / ut: unmatched points; ids from 1."""
    of = r"/(\d+)/(pd|sd|as|at|us|ut)(AB|AC)([^/]*)\.txt$"
    out = {}
    for kind, read in (("pd", read_matrix), ("sd", read_vector), ("as", read_ragged), ("at", read_ragged), ("us", read_ragged_row), ("ut", read_ragged_row)):
        d = read(spark, f"{folder}/triplet/*/{kind}A*.txt")
        d = d.withColumn("triplet_id", F.regexp_extract("path", of, 1).cast("int")).withColumn("pair", F.regexp_extract("path", of, 3)).withColumn("sigma", F.regexp_extract("path", of, 4)).drop("path")
        if "ids" in d.columns:
            d = d.withColumn("ids", F.transform("ids", lambda x: x + 1))
        out[kind] = d
    return out


def read_ragged_row(spark: SparkSession, path: str) -> DataFrame:
    """(path, ids): an int32 length and as many int32."""
    return _decode(spark, path, "ids array<int>", lambda data: pd.DataFrame({"ids": [np.frombuffer(data, "<i4")[1:].copy()]}))


def write_lines(df: DataFrame, path: str, columns: list[str], order: list[str], sep: str = " ") -> None:
    """Text with the columns of a row on a line, in order, as one sorted set of part files (weights, cases, votes)."""
    line = F.concat_ws(sep, *[F.col(c).cast("string") for c in columns])
    df.sort(*order).select(line.alias("value")).write.mode("overwrite").text(path)


def record_bytes(rows: pd.DataFrame, element: str, comments: tuple[str, ...] = ()) -> bytes:
    """A binary PLY file with one property per column: floats as float, integers as int."""
    kinds = [(c, "<i4" if rows[c].dtype.kind in "iu" else "<f4") for c in rows.columns]
    lines = ["ply", "format binary_little_endian 1.0", *[f"comment {c}" for c in comments], f"element {element} {len(rows)}", *[f"property {'int' if k == '<i4' else 'float'} {c}" for c, k in kinds], "end_header"]
    out = np.empty(len(rows), np.dtype(kinds))
    for c, _ in kinds:
        out[c] = rows[c]
    return ("\n".join(lines) + "\n").encode() + out.tobytes()


def sample_files(samples: DataFrame) -> DataFrame:
    """(shape_id, content): each shape's samples, by point_id, as the bytes of a sample file with its radius as a comment.

    A sample file is one record stream, so a shape is written in one task."""
    names = ["x", "y", "z", "nx", "ny", "nz", "face_id"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("point_id")
        return pd.DataFrame({"shape_id": [g["shape_id"].iloc[0]], "content": [record_bytes(g[names], "vertex", (f"SAMPLE_RADIUS {g['radius'].iloc[0]:g}",))]})

    return samples.groupBy("shape_id").applyInPandas(run, f"shape_id {dict(samples.dtypes)['shape_id']}, content binary")
