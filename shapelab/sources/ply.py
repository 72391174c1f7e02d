"""Triangle meshes and point samples in binary little-endian PLY files.

Files are read as Spark's binaryFile source gives them, so that their paths may be in any store, and decoded file by
file in tasks. A vertex is six floats (position, normal); a face a count byte and as many ints, of which only
triangles are kept; a sample is six floats and the id of its face."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERTEX = np.dtype([(c, "<f4") for c in ("x", "y", "z", "nx", "ny", "nz")])
SAMPLE = np.dtype([*VERTEX.descr, ("face_id", "<i4")])


def header(data: bytes) -> tuple[dict[str, int], list[str], int]:
    """Counts by element, comments, and where the body begins."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    begin = data.index(b"\n", end) + 1
    counts, comments = {}, []
    for line in data[:end].decode("latin-1").splitlines():
        part = line.split()
        if part[:1] == ["element"]:
            counts[part[1]] = int(part[2])
        elif part[:1] == ["comment"]:
            comments.append(line.strip()[8:])
    return counts, comments, begin


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """(path, vertex_id, x, y, z, nx, ny, nz)"""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"]):
                counts, _, at = header(data)
                v = pd.DataFrame(np.frombuffer(data, VERTEX, counts.get("vertex", 0), at).astype([(c, "f4") for c in VERTEX.names]))
                v.insert(0, "path", name)
                v.insert(1, "vertex_id", np.arange(len(v), dtype=np.int32))
                yield v

    return _files(spark, path).mapInPandas(run, "path string, vertex_id int, x float, y float, z float, nx float, ny float, nz float")


def read_faces(spark: SparkSession, path: str) -> DataFrame:
    """(path, face_id, v0, v1, v2): triangles in file order; other faces are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"]):
                counts, _, at = header(data)
                at += counts.get("vertex", 0) * VERTEX.itemsize
                rows = []
                for _ in range(counts.get("face", 0)):
                    n = data[at]
                    if n == 3:
                        rows.append(np.frombuffer(data, "<i4", 3, at + 1))
                    at += 1 + 4 * n
                f = pd.DataFrame(np.array(rows, np.int32).reshape(-1, 3), columns=["v0", "v1", "v2"])
                f.insert(0, "path", name)
                f.insert(1, "face_id", np.arange(len(f), dtype=np.int32))
                yield f

    return _files(spark, path).mapInPandas(run, "path string, face_id int, v0 int, v1 int, v2 int")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(path, point_id, x .. nz, face_id, radius); the comment SAMPLE_RADIUS is required."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"]):
                counts, comments, at = header(data)
                radius = next((float(m[1]) for c in comments if (m := re.match(r"SAMPLE_RADIUS\s+(\S+)", c))), None)
                if radius is None:
                    raise ValueError(f"{name}: no SAMPLE_RADIUS")
                n = next(iter(counts.values()), 0)
                s = pd.DataFrame(np.frombuffer(data, SAMPLE, n, at).astype([(c, SAMPLE[c].newbyteorder("=")) for c in SAMPLE.names]))
                s.insert(0, "path", name)
                s.insert(1, "point_id", np.arange(len(s), dtype=np.int32))
                s["radius"] = np.float32(radius)
                yield s

    return _files(spark, path).mapInPandas(run, "path string, point_id int, x float, y float, z float, nx float, ny float, nz float, face_id int, radius float")


def ply_bytes(vertices: np.ndarray, faces: np.ndarray | None = None, comments: tuple[str, ...] = ()) -> bytes:
    """A mesh or point set (no faces) as a binary PLY file. vertices: n x 6, faces: m x 3."""
    lines = ["ply", "format binary_little_endian 1.0", *[f"comment {c}" for c in comments], f"element vertex {len(vertices)}", *[f"property float {c}" for c in VERTEX.names]]
    body = np.ascontiguousarray(vertices, "<f4").tobytes()
    if faces is not None:
        lines += [f"element face {len(faces)}", "property list uchar int vertex_indices"]
        rows = np.empty(len(faces), np.dtype([("n", "u1"), ("v", "<i4", 3)]))
        rows["n"], rows["v"] = 3, faces
        body += rows.tobytes()
    return ("\n".join([*lines, "end_header"]) + "\n").encode() + body


def as_files(points: DataFrame, key: str) -> DataFrame:
    """(key, content): each group's points, ordered by vertex_id, as the bytes of a PLY file; written by any sink."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("vertex_id")
        return pd.DataFrame({key: [g[key].iloc[0]], "content": [ply_bytes(g[list(VERTEX.names)].to_numpy())]})

    return points.groupBy(key).applyInPandas(run, f"{key} {dict(points.dtypes)[key]}, content binary")


def shapes(spark: SparkSession, list_path: str) -> DataFrame:
    """(shape_id, name) of a list of names, one a line, up to the first blank line; ids from 1."""
    lines = spark.read.text(list_path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "name"))
    blank = lines.where(F.trim("name") == "").agg(F.min("at").alias("end"))
    return lines.crossJoin(F.broadcast(blank)).where("end is null or at < end").select((F.col("at") + 1).alias("shape_id"), F.trim("name").alias("name"))
