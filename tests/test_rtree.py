"""Neighbour joins by packed boxes, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelab.operators import rtree

SCHEMA = "key string, id long, v array<double>, w double"


def cloud(seed: int, n: int, dims: int, keys: str = "ab"):
    """Half of the points in one tiny place, some of them equal, and the rest scattered."""
    r = np.random.default_rng(seed)
    v = np.concatenate([r.normal(0, 1e-4, (n // 2, dims)).round(5), r.normal(0, 1, (n - n // 2, dims))])
    return [(keys[i % len(keys)], i, v[i].tolist(), float(i)) for i in range(n)]


def brute(rows, queries, k=None, radius=None):
    out = []
    for q, key, at in queries:
        found = sorted((float(np.sqrt(((np.array(v) - at) ** 2).sum())), i) for g, i, v, _ in rows if g == key)
        if radius is not None:
            found = [f for f in found if f[0] <= radius]
        out += [(q, i, round(d, 9)) for d, i in (found if k is None else found[:k])]
    return sorted(out)


@pytest.mark.parametrize("sent", [rtree.SENT, 1])
@pytest.mark.parametrize(("dims", "k", "radius"), [(3, 1, None), (9, 40, None), (3, None, 0.5), (3, 3, 0.3)])
def test_search(spark, monkeypatch, dims, k, radius, sent):
    monkeypatch.setattr(rtree, "SENT", sent)
    rows = cloud(dims, 900, dims)
    queries = [(q, "abc"[q % 3], v) for q, (_, _, v, _) in enumerate(cloud(7, 60, dims))]
    tree = rtree.build(spark.createDataFrame(rows, SCHEMA), dims)
    assert len(tree.levels) > 1
    got = rtree.search(tree, spark.createDataFrame(queries, "query long, key string, at array<double>"), k, None if radius is None else F.lit(radius))
    assert sorted((r.query, r.id, round(r.d, 9)) for r in got.collect()) == brute(rows, queries, k, radius)


def test_leaves_are_small_where_points_are_dense(spark):
    tree = rtree.build(spark.createDataFrame(cloud(1, 2000, 3, "a"), SCHEMA), 3)
    sizes = [r.n for r in tree.levels[0].select(F.size("kids").alias("n")).collect()]
    assert max(sizes) <= rtree.FAN and sum(sizes) == 2000
    assert tree.levels[-1].count() == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    q = spark.createDataFrame([(1, "a", [0.0, 0.0, 0.0])], "query long, key string, at array<double>")
    assert rtree.search(rtree.build(none, 3), q, 2).count() == 0
    one = rtree.build(spark.createDataFrame([("a", 5, [1.0, 0.0, 0.0], 1.0)], SCHEMA), 3)
    assert [tuple(r) for r in rtree.search(one, q, 2).select("query", "id", "d").collect()] == [(1, 5, 1.0)]
    assert rtree.search(one, q.where("false"), 2).count() == 0


def test_crowded_grids_give_the_same_rows(spark, monkeypatch):
    """The joins on grid cells, with the grid and with packed boxes in its place."""
    from shapelab.operators import spatial

    points = spark.createDataFrame([(i, *v) for _, i, v, _ in cloud(4, 300, 3)], "id long, x double, y double, z double")
    queries = points.withColumnRenamed("id", "query")

    def rows(df):
        return sorted((r.query, r.id, round(r.d, 9), r["rank"] if "rank" in df.columns else 0) for r in df.collect())

    def all_three():
        return [rows(spatial.radius_join(points, queries, 0.05)), rows(spatial.within(points, queries, 0.4, 5)), rows(spatial.nearest_on_grid(points, queries.where("query % 7 = 0"), 3, 0.1))]

    assert not spatial.crowded(points, 0.05)
    grid = all_three()
    monkeypatch.setattr(spatial, "CROWDED", 10)
    assert spatial.crowded(points, 0.05)
    assert all_three() == grid and all(grid)
