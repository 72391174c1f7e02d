"""Operators against small brute-force versions, with empty tables, ties and nulls."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelab.functions import hist, rank, score, vec
from shapelab.operators import sets, spatial
from shapelab.operators.graph import components


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (80, 2))] + [(i, i + 1) for i in range(200, 240)] + [(7, None), (5, 5)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    label = {x: x for p in pairs if None not in p for x in p}
    for _ in label:
        for a, b in pairs:
            if b is not None:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_hazen(spark, p):
    v = [float(x) for x in [3, 3, 3, 1, 9, -4, 2.5, 9, 0]]
    df = spark.createDataFrame([("a", x) for x in v] + [("b", 5.0), ("c", None)], "k string, v double")
    got = {r[0]: r[1] for r in rank.hazen(df, ["k"], "v", p).collect()}
    assert got["a"] == pytest.approx(float(np.percentile(v, 100 * p, method="hazen")))
    assert got["b"] == 5.0 and "c" not in got


def test_nth(spark):
    df = spark.createDataFrame([(float(x),) for x in [4, 1, 1, 8, 8, 8]], "v double")
    assert [r[0] for r in rank.upper_median(df, [], "v").collect()] == [8.0]


def test_histogram_and_emd(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.1), ("a", 0.9), ("b", 0.5), ("c", None)], "k string, v double")
    h = hist.histogram(df, ["k"], "v", 8)
    total = {r[0]: r[1] for r in h.groupBy("k").agg(F.sum("p")).collect()}
    assert all(x == pytest.approx(1) for x in total.values()) and set(total) == {"a", "b", "c"}
    rows = {(r.k, r.bin): r.p for r in h.collect()}
    assert all(rows["c", b] == pytest.approx(1 / 8) for b in range(8))

    def one(values):
        w = np.zeros(8)
        for v in values:
            pos = v * 8
            for b in range(max(0, int(pos - 6)), min(7, int(pos + 6)) + 1):
                w[b] += math.exp(-((pos - b - 0.5) ** 2) / 8)
        return w / w.sum()

    a, b = one([0.1, 0.1, 0.9]), one([0.5])
    assert [rows["a", i] for i in range(8)] == pytest.approx(list(a))
    e = {(r.a, r.b): r.emd for r in hist.emd(h, "k").collect()}
    assert e["a", "b"] == pytest.approx(np.abs(np.cumsum(a) - np.cumsum(b)).sum())
    assert {r.p for r in hist.histogram(df, ["k"], "v", 4, 1, 1).collect()} == {0.25}


def test_vectors(spark):
    r = spark.createDataFrame([([1.0, 2.0], [3.0, 0.0])], "a array<double>, b array<double>").select(vec.dot(F.col("a"), F.col("b")), vec.l1(F.col("a"), F.col("b")), vec.l2(F.col("a"), F.col("b")), vec.chi2(F.col("a"), F.col("b"))).first()
    assert list(r) == pytest.approx([3, 4, math.sqrt(8), 1 + 2])


def test_scores(spark):
    r = spark.range(1).select(score.sigmoid(F.lit(99.0)), score.sigmoid(F.lit(-99.0)), score.scaled(F.lit(5.0), F.lit(0.0)), score.scaled(F.lit(1.0), F.lit(4.0)), score.axis_stretch(F.lit(-0.5)), *score.energy_terms(F.lit(1.0), 2.0)).first()
    assert list(r) == pytest.approx([1 - 1e-6, 1e-6, 1.0, 0.25, 1.0, 0.5, -math.log(1 - math.exp(-0.5) + 1e-5)])


def test_nearest(spark):
    rng = np.random.default_rng(3)
    v = rng.random((60, 5))
    v[7] = v[9]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    for metric in ("l2", "chi2"):
        got = {(r.query, r.rank): r.id for r in spatial.nearest(rows, rows.where("id % 20 = 0"), 4, metric).collect()}
        for q in (0, 20, 40):
            d = ((v - v[q]) ** 2 / (1 if metric == "l2" else v + v[q])).sum(axis=1)
            want = sorted((i for i in range(60) if i != q), key=lambda i: (d[i], i))[:4]
            assert [got[q, k] for k in range(1, 5)] == want
    assert spatial.nearest(rows, rows.where("id < 0"), 4).count() == 0


def test_radius(spark):
    rng = np.random.default_rng(4)
    p = rng.random((150, 3)) - 0.5
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    got = {(r[0], r[1]) for r in spatial.radius_join(df, df.withColumnRenamed("id", "query"), 0.2).collect()}
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= 0.2))}


def test_sets(spark):
    e = spark.createDataFrame([(2, 1), (1, 2), (3, 3), (4, None)], "u long, v long")
    assert [tuple(r) for r in sets.canonical_pairs(e, "u", "v").collect()] == [(1, 2)]
    assert sets.both_directions(e.where("u = 2"), "u", "v").count() == 2
    t = spark.createDataFrame([(1, 5, 6, 7), (2, 6, 5, 8), (3, 9, 10, 11)], "t long, a long, b long, c long")
    assert [r.t for r in sets.separated(t.where("t > 1"), t.where("t = 1")).collect()] == [3]
    m = spark.createDataFrame([("x", 1), ("x", 0), ("y", 0), ("y", 0)], "g string, h int")
    assert [r.g for r in sets.covered(m, ["g"], F.col("h") == 1, 0.5).collect()] == ["x"]


def test_bandwidth_of_many_rows(spark, tmp_path):
    """A hundredth of 2550 rows is more than 20 neighbours: the 26th is the first over it."""
    from shapelab.plans import geometry

    v = np.random.default_rng(7).random((2550, 4))
    spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.query: r.bandwidth for r in geometry.bandwidth_cumweight(spark, str(tmp_path)).collect()}
    want = {i: round(float(np.sort(np.linalg.norm(v - v[i], axis=1))[26]), 6) for i in range(0, 2550, 20)}
    assert got == pytest.approx(want, abs=2e-6)
