import numpy as np
import pytest

from shapelab.sources import ply, ply_format

SHAPE = f"name string, vertices array<struct<{', '.join(c.strip().replace(' ', ':') for c in ply_format.VERTEX.split(','))}>>, faces array<array<int>>, edges array<struct<v0:int,v1:int>>"


@pytest.mark.parametrize("encoding", ["binary", "ascii"])
def test_round_trip(spark, tmp_path, encoding):
    spark.dataSource.register(ply_format.PlySource)
    full = [(0.5 * i, -1.25, 1e-7 * i, 0.0, 0.0, 1.0, i, 255, 0) for i in range(5)]
    bare = [(float(i), 2.0, 3.0, *[None] * 6) for i in range(3)]
    rows = [("a", full, [(0, 1, 2), (0, 1, 2, 3)], [(0, 1), (3, 4)]), ("b", bare, None, [(1, 2)]), ("c", [], [], None)]
    spark.createDataFrame(rows, SHAPE).repartition(2).write.format("ply").option("encoding", encoding).mode("append").save(str(tmp_path))
    read = lambda e: spark.read.format("ply").option("element", e).load(str(tmp_path))
    got = read("vertex")
    assert got.rdd.getNumPartitions() == 3
    by = {k: [tuple(r)[2:] for r in got.where(got.path.endswith(f"{k}.ply")).orderBy("id").collect()] for k in "abc"}
    assert by["b"] == bare and by["c"] == [] and np.allclose(by["a"], full, atol=1e-12)
    assert sorted((r.path[-5], r.id, tuple(r.vertices)) for r in read("face").collect()) == [("a", 0, (0, 1, 2)), ("a", 1, (0, 1, 2, 3))]
    assert sorted((r.path[-5], r.id, r.v0, r.v1) for r in read("edge").collect()) == [("a", 0, 0, 1), ("a", 1, 3, 4), ("b", 0, 1, 2)]


def test_other_files(spark, tmp_path):
    """Files of the older writer, of the other byte order, and no files at all."""
    spark.dataSource.register(ply_format.PlySource)
    assert spark.read.format("ply").load(str(tmp_path)).count() == 0
    v = np.arange(12, dtype=float).reshape(2, 6)
    (tmp_path / "old.ply").write_bytes(ply.ply_bytes(v, np.array([[0, 1, 1]])))
    big = b"ply\nformat binary_big_endian 1.0\nelement vertex 1\nproperty double x\nproperty float y\nproperty int z\nend_header\n" + np.array([(1.5, 2, 3)], ">f8,>f4,>i4").tobytes()
    (tmp_path / "big.ply").write_bytes(big)
    got = {(r.path.rsplit("/", 1)[1], r.id): (r.x, r.y, r.nz) for r in spark.read.format("ply").load(str(tmp_path)).collect()}
    assert got == {("old.ply", 0): (0, 1, 5), ("old.ply", 1): (6, 7, 11), ("big.ply", 0): (1.5, 2, None)}
    assert [list(r.vertices) for r in spark.read.format("ply").option("element", "face").load(str(tmp_path)).collect()] == [[0, 1, 1]]
    with pytest.raises(ValueError):
        list(ply_format.values(b"plot", "vertex"))
