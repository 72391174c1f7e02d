"""Findings of the third round's last passes: the number of searches of the patch distances, and what shortest paths keep."""

import duckdb
import numpy as np

from shapelab.operators import cluster, rtree, spatial
from shapelab.plans import registry

TWINS = """copy (select (row_number() over (order by vec_id) - 1) * 2 + k as vec_id, embedding, label
 from '/root/testdata/sf0.001/embeddings.parquet', (select unnest([0, 1]) as k) where vec_id < 120) to '{}' (format parquet)"""


def _counted(monkeypatch):
    built, build = [], rtree.build
    monkeypatch.setattr(rtree, "build", lambda *a: built.append(1) or build(*a))
    return built


def test_patch_metrics_takes_few_searches(spark, tmp_path, monkeypatch):
    # each even point has an odd twin, so that there are elements
    duckdb.sql(TWINS.format(tmp_path / "embeddings.parquet"))
    built = _counted(monkeypatch)
    got = {(r.mode, r.element, r.metric): r.value for r in registry.queries()["patch_metrics"](spark, str(tmp_path)).collect()}
    assert len(built) <= 4
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    want = {r[:3]: r[3] for r in duck.execute(registry.oracle_sql()["patch_metrics"]).fetchall()}
    assert got.keys() == want.keys() and got and all(abs(got[k] - v) <= 2e-5 for k, v in want.items())


def test_patch_metrics_without_elements(spark, tmp_path, monkeypatch):
    duckdb.sql(f"copy (select * from '/root/testdata/sf0.001/embeddings.parquet' where vec_id % 2 = 0) to '{tmp_path}/embeddings.parquet' (format parquet)")
    built = _counted(monkeypatch)
    df = registry.queries()["patch_metrics"](spark, str(tmp_path))
    assert df.columns == ["mode", "element", "metric", "value"] and df.isEmpty() and len(built) <= 2


def _points(n):
    """Clustered places, some of them equal, and one far off."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(0, 0.1, (n // 2, 3)), r.uniform(-0.3, 0.3, (n - n // 2, 3))])
    x[5], x[6], x[20] = x[0], x[0], 9.0
    return [(i, *map(float, v)) for i, v in enumerate(x)]


def test_path_means_keep_no_labels(spark, monkeypatch):
    """A tile's task adds up its labels: none are joined with edges, which are never made."""
    rows = [*_points(700), (720, None, 0.0, 0.0), (721, float("nan"), 0.0, 0.0)]
    p = spark.createDataFrame(rows, "id long, x double, y double, z double")
    sources = p.where("id % 20 = 0")
    e = spatial.radius_join(p, p.withColumnRenamed("id", "query"), 0.06).where("query <> id").selectExpr("query as src", "id as dst", "d as weight")
    want = {r.source: (r.n, r.m) for r in cluster.shortest_paths(e, sources.selectExpr("id as node"), 0.3).groupBy("source").agg({"node": "count", "d": "avg"}).toDF("source", "n", "m").collect()}
    monkeypatch.setattr(cluster, "LABELS", 2000)
    monkeypatch.setattr(cluster, "MET_AT_ONCE", 7)
    got = {r.source: (r.reached, r.mean) for r in cluster.path_means(p, sources, 0.06, 0.3).collect()}
    assert got.keys() == want.keys() and got[20] == got[720] == (1, 0.0)
    assert all(got[k][0] == n and abs(got[k][1] - m) < 1e-12 for k, (n, m) in want.items())


def test_geodesic_makes_no_edges(spark, monkeypatch):
    def fail(*a, **k):
        raise AssertionError("edges or labels leave a task")

    monkeypatch.setattr(spatial, "radius_join", fail)
    monkeypatch.setattr(cluster, "shortest_paths", fail)
    assert registry.queries()["geodesic"](spark, "/root/testdata/sf0.001").count() == 25
