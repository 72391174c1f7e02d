"""What was found on larger tables: searches in blocks, k-means by sums, neighbours as the SQL has them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelab.operators import cluster, rtree, spatial
from shapelab.plans import geometry


def test_bandwidth_looks_at_as_many_neighbours_as_its_sql(spark, tmp_path):
    """Twenty of 2200 rows weigh less than a hundredth, so that the SQL has no rows; the query had one for each query point."""
    r = np.random.default_rng(0)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(r.normal(0, 1, (2200, 4)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert geometry.bandwidth_cumweight(spark, str(tmp_path)).count() == 0


def test_kmeans_sends_sums_of_tasks_and_no_literals(spark):
    r = np.random.default_rng(1)
    v = r.normal(0, 1, (300, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").cache()
    out, centres = cluster.kmeans(df, 4)
    assert len(out._jdf.queryExecution().analyzed().toString()) < 5000  # 4 x 64 numbers of the centres were in the plan of each step
    c = np.array(centres)
    d = np.sqrt(((v[:, None] - c[None]) ** 2).sum(axis=2))
    got = {x.id: (x.cluster, x.d) for x in out.collect()}
    assert all(got[i][0] == d[i].argmin() and got[i][1] == pytest.approx(d[i].min()) for i in range(300))
    assert all(np.allclose(c[k], v[[got[i][0] == k for i in range(300)]].mean(0)) for k in range(4))


def test_a_query_visits_few_leaves_whose_points_stay_there(spark):
    """The nearest leaf bounds the search before others are visited, and queries are gathered by leaf."""
    v = np.random.default_rng(2).random((3000, 3))
    points = spark.createDataFrame([(0, i, x.tolist(), True) for i, x in enumerate(v)], "key int, id long, v array<double>, w boolean")
    tree = rtree.build(points, 3)
    found = rtree._searched(tree, points.where("id % 10 = 0").select(F.col("id").alias("query"), "key", F.col("v").alias("at")), 1, None, True)
    assert found.count() <= 2 * 300
    rows = rtree.search(tree, points.where("id % 10 = 0").select(F.col("id").alias("query"), "key", F.col("v").alias("at")), 1, bare=True).collect()
    assert len(rows) == 300 and all(x.query == x.id and x.d == 0 for x in rows)


def test_cells_of_a_hundred_points_are_crowded(spark):
    """A grid cell of thousands made millions of pairs of each few rows before boxes took its place."""
    v = np.random.default_rng(3).random((100, 3)) * 0.09
    assert spatial.crowded(spark.createDataFrame([tuple(map(float, x)) for x in v], "x double, y double, z double"), 0.1)


def test_pairs_of_samples_take_all_steps_in_a_task(spark):
    """The transforms are those of steps over all pairs at once."""
    from shapelab.operators import voting
    from tests.test_voting import POINTS, shape

    a, b = (voting.sample(spark.createDataFrame(shape(k, 2, 30), POINTS)) for k in (2, 3))
    state = voting.begun(voting.similar_pairs(voting.frames(a, 0.1), voting.frames(b, 0.1)))
    one, other = ({(r.s, r.t, r.start): np.array(r.a) for r in x.collect()} for x in (voting.icp_of_samples(state, a, b, 2), voting.icp(state, a, voting.tree_of(b), 2)))
    assert set(one) == set(other) and len(one) >= 5
    assert all(np.allclose(one[k], other[k], atol=1e-9) for k in one)


def test_groups_are_scanned_and_searched_alike(spark, monkeypatch):
    from shapelab.operators import modes

    r = np.random.default_rng(4)
    rows = [(int(k), i, i % 40 == 0, float(r.integers(0, 9)), r.random(3).tolist(), [0.0, float(np.sin(x)), 0.0, float(np.cos(x))], [float(s), 1.0, 1.0]) for i, (k, x, s) in enumerate(zip(r.integers(0, 9, 200), r.choice([0.0, 0.03, 0.06], 200), r.choice([1.0, 1.06, 1.2, 6.0], 200), strict=True))]
    df = spark.createDataFrame(rows, "key int, id int, pinned boolean, weight double, t array<double>, q array<double>, s array<double>")
    monkeypatch.setattr(modes, "GROUPS", 2)
    scanned = sorted(modes.pruned(df, 0.15).collect())
    monkeypatch.setattr(modes, "SCANNED", 20)
    assert sorted(modes.pruned(df, 0.15).collect()) == scanned and 20 < len(scanned) < 190


def test_small_groups_get_no_quantiles(spark):
    from shapelab.functions import rank

    df = spark.range(6).selectExpr("id % 2 as k", "id as v")
    got = rank.upper_median(df, ["k"], "v")
    assert "percentile" not in got._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in got.collect()) == [(0, 2), (1, 3)]


def test_small_and_large_groups_have_exact_ranks(spark, monkeypatch):
    from shapelab.functions import rank

    monkeypatch.setattr(rank, "FEW", 5)
    df = spark.range(60).selectExpr("case when id < 4 then 1 else 2 end as k", "cast(id as double) as v")
    assert sorted(tuple(r) for r in rank.upper_median(df, ["k"], "v").collect()) == [(1, 2.0), (2, 32.0)]


def test_means_of_nearest_are_those_of_neighbours(spark, monkeypatch):
    """Bounds of a small sample, also ones that mislead, change nothing."""
    r = np.random.default_rng(5)
    v = np.abs(r.normal(0, 1, (400, 6)))
    v[:30] = v[0]
    rows = spark.createDataFrame([(i, x.tolist(), x[:3].tolist()) for i, x in enumerate(v)], "id long, v array<double>, u array<double>")
    d = np.array([[sum((a - b) ** 2 / (a + b) for a, b in zip(x, y, strict=True)) for y in v] for x in v[::20]])
    want = {}
    for i, row in zip(range(0, 400, 20), d, strict=True):
        near = sorted((row[j], j) for j in range(400) if j != i)[:40]
        want[i] = np.mean([x / (1 + np.sqrt(((v[j, :3] - v[i, :3]) ** 2).sum())) for x, j in near])
    for sample, errors in ((10_000, 5.0), (90, 5.0), (90, 0.0)):
        monkeypatch.setattr(spatial, "SAMPLE", sample)
        monkeypatch.setattr(spatial, "ERRORS", errors)
        got = {x.query: x["mean"] for x in spatial.means_of_nearest(rows, rows.where("id % 20 = 0"), 40, lambda d, gap: d / (1 + gap), "chi2").collect()}
        assert set(got) == set(want) and all(np.isclose(got[i], want[i], atol=1e-9) for i in want)


def test_thinning_by_stretches(spark, monkeypatch):
    """Stretches of few points keep what one over all keeps, and make fewer pairs."""
    from shapelab.plans import matching

    r = np.random.default_rng(6)
    rows = [(i * 3, tuple(n), *map(float, x)) for i, (n, x) in enumerate(zip(r.normal(0, 1, (300, 3)).tolist(), r.random((300, 3)) * 2, strict=True))]
    p = spark.createDataFrame(rows, "id long, n struct<x double, y double, z double>, x double, y double, z double".replace("x double, y double, z double>", "x: double, y: double, z: double>"))
    whole = sorted(x.id for x in matching.thinned(p, 0.5).collect())
    sizes, join = [], spatial.radius_join
    monkeypatch.setattr(matching, "STRETCH", 20)
    monkeypatch.setattr(spatial, "radius_join", lambda a, b, radius: sizes.append(a.count()) or join(a, b, radius))
    assert sorted(x.id for x in matching.thinned(p, 0.5).collect()) == whole
    assert len(sizes) > 2 and max(sizes) < 200 and 10 < len(whole) < 250


def test_descriptors_meet_points_by_leaf(spark, monkeypatch):
    """The nearest few within the radius, ties by id, also in a place of many points and over several levels; no pair is shuffled."""
    from shapelab.plans import descriptors

    monkeypatch.setattr(rtree, "FAN", 4)
    r = np.random.default_rng(7)
    v = r.random((160, 3))
    v[:20] = v[0]
    zero = [0.0, 0.0, 1.0]
    o = spark.createDataFrame([(i, tuple(x), tuple(zero)) for i, x in enumerate(v.tolist())], "id long, p struct<x: double, y: double, z: double>, n struct<x: double, y: double, z: double>")
    got = {x.id: (x.total, x.v) for x in descriptors.around(o.withColumn("e", F.array(F.col("id").cast("double"))), 0.3, 9, lambda d, gap, u, n, e: (len(d), [e.sum()]), 1, F.col("e")).collect()}
    for i in range(160):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        near = sorted((d[j], j) for j in range(160) if j != i and d[j] <= 0.3)[:9]
        assert got[i] == (len(near), [sum(j for _, j in near)])
