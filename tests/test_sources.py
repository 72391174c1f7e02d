"""Readers against files written here, and the streaming operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelab.sources import arrays, config, ply
from shapelab.streaming import arrivals


def test_ply(spark, tmp_path):
    rng = np.random.default_rng(0)
    v, f = rng.random((9, 6)).astype("f4"), rng.integers(0, 9, (5, 3))
    (tmp_path / "a.ply").write_bytes(ply.ply_bytes(v, f, ("made here",)))
    got = ply.read_vertices(spark, str(tmp_path / "a.ply")).orderBy("vertex_id").toPandas()
    assert np.array_equal(got[list(ply.VERTEX.names)].to_numpy("f4"), v)
    assert [tuple(r)[1:] for r in ply.read_faces(spark, str(tmp_path / "a.ply")).orderBy("face_id").collect()] == [(i, *map(int, x)) for i, x in enumerate(f)]
    again = ply.as_files(ply.read_vertices(spark, str(tmp_path / "a.ply")), "path").first()
    assert again.content == ply.ply_bytes(v)
    s = np.zeros(3, ply.SAMPLE)
    s["face_id"] = [4, 5, 6]
    head = "ply\nformat binary_little_endian 1.0\ncomment SAMPLE_RADIUS 0.25\nelement sample 3\nend_header\n"
    (tmp_path / "s.ply").write_bytes(head.encode() + s.tobytes())
    rows = ply.read_samples(spark, str(tmp_path / "s.ply")).orderBy("point_id").collect()
    assert [(r.point_id, r.face_id, r.radius) for r in rows] == [(0, 4, 0.25), (1, 5, 0.25), (2, 6, 0.25)]
    (tmp_path / "names.txt").write_text("one\ntwo\n\nnot this\n")
    assert [tuple(r) for r in ply.shapes(spark, str(tmp_path / "names.txt")).orderBy("shape_id").collect()] == [(1, "one"), (2, "two")]


def test_arrays(spark, tmp_path):
    m = np.array([[1.0, np.nan], [3.0, 4.0], [np.inf, -1.0]])
    (tmp_path / "m.bin").write_bytes(arrays.matrix_bytes(m))
    got = arrays.read_matrix(spark, str(tmp_path / "m.bin"), clean=True).orderBy("row").collect()
    assert [r.v for r in got] == [[1, 0], [3, 4], [0, -1]]
    (tmp_path / "v.bin").write_bytes(np.array([2], "<i4").tobytes() + np.array([0.5, 7], "<f8").tobytes())
    assert [r.v for r in arrays.read_vector(spark, str(tmp_path / "v.bin")).orderBy("at").collect()] == [0.5, 7]
    (tmp_path / "f.bin").write_bytes(np.array([1, 2, 3], "<f8").tobytes())
    assert arrays.read_feature(spark, str(tmp_path / "f.bin")).agg(F.sum("v")).first()[0] == 6
    (tmp_path / "r.bin").write_bytes(np.array([3, 2, 8, 9, 0, 1, 5], "<i4").tobytes())
    assert [r.ids for r in arrays.read_ragged(spark, str(tmp_path / "r.bin")).orderBy("row").collect()] == [[8, 9], [], [5]]
    (tmp_path / "t.txt").write_text("1 2\n3 4.5\n")
    assert [r.v for r in arrays.read_text_matrix(spark, str(tmp_path / "t.txt")).orderBy("row").collect()] == [[1, 2], [3, 4.5]]
    (tmp_path / "bad.txt").write_text("1 2\n3\n")
    with pytest.raises(Exception, match="rows differ"):
        arrays.read_text_matrix(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "seg.txt").write_text("2\n3 7 8 9\n1 4\n")
    assert [(r.segment_id, r.pos, r.point_id) for r in arrays.read_segments(spark, str(tmp_path / "seg.txt"), 2).orderBy("pos").collect()] == [(0, 0, 7), (0, 1, 8), (0, 2, 9)]


def test_config():
    got = config.merged("[A]\nx = 1 // one\n\n", "[A]\nx = 2\n[B]\nflag = True\nlist = 1, 2 3\n")
    assert got == {"A": {"x": "2"}, "B": {"flag": "True", "list": "1, 2 3"}}
    assert config.as_bool(got["B"]["flag"]) and config.as_list(got["B"]["list"]) == [1, 2, 3]
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        config.parse("what")
        config.as_bool("yes")


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", 1, 0.0, 1.0, 2.0), ("2024-01-01 00:02:00", 1, 5.0, 1.0, -2.0), ("2024-01-01 00:15:00", 2, 1.0, 1.0, 1.0)], "ts string, shape_id int, x double, y double, z double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = arrivals.windowed_boxes(stream).writeStream.format("memory").queryName("boxes").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.shape_id, r.n, r.x0, r.x1, r.z0, r.z1) for r in spark.table("boxes").collect()}
    assert got == {(1, 2, 0.0, 5.0, -2.0, 2.0), (2, 1, 1.0, 1.0, 1.0, 1.0)}
    arrivals.each_batch(stream, lambda b: b.groupBy("shape_id").count(), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
