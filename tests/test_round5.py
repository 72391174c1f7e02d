"""Findings of round 3, third pass."""

import numpy as np

from shapelab.operators import cluster, graph


def _tasks(spark, name, run):
    """Tasks that `run` takes, with shuffles of 50 parts that stay apart."""
    conf, sc = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}, spark.sparkContext
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup(name, name)
        out = run()
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(name)]
        stages = [sc.statusTracker().getStageInfo(s) for s in {s for j in jobs for s in j.stageIds}]
        return out, sum(s.numCompletedTasks for s in stages if s)
    finally:
        sc._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rounds_of_components_take_few_tasks(spark):
    """The driver keeps a record of each task: a round of few rows must not run all parts of its shuffles again and again."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    got, tasks = _tasks(spark, "components", lambda: graph.components(edges).collect())
    assert {r.component for r in got} == {0} and len(got) == 41
    assert tasks < 1600, tasks


def test_mean_shift_makes_no_pairs(spark):
    """Sums leave a task, not pairs: what a step shuffles doesn't grow with the square of the points."""
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.normal(m, 0.03, (700, 3)) for m in (0.0, 1.0)])
    w = rng.integers(1, 4, len(p)).astype(float)
    rows = [(i, *map(float, x), float(y)) for i, (x, y) in enumerate(zip(p, w))] + [(5000, None, 1.0, 1.0, 1.0), (5001, 9.0, 9.0, 9.0, 2.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, w double").repartition(4)
    store = spark.sparkContext._jsc.sc().statusStore()

    def written() -> int:
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    got = {r.id: (r.x, r.y, r.z) for r in cluster.mean_shift(df, 0.1).collect()}
    assert written() - before < 200 * len(rows)  # a step alone makes over 500 pairs for each point
    at = p.copy()
    for _ in range(1000):
        near = (np.sqrt(((at[:, None] - p[None]) ** 2).sum(-1)) <= 0.1) * w
        new = (near @ p) / near.sum(axis=1, keepdims=True)
        moved, at = (((new - at) ** 2).sum(axis=1) > 1e-8).any(), new
        if not moved:
            break
    assert len(got) == len(rows) and got[5000] == (None, 1.0, 1.0) and got[5001] == (9.0, 9.0, 9.0)
    assert np.allclose([got[i] for i in range(len(p))], at, atol=1e-8)


def test_mean_shift_over_blocks(spark, monkeypatch):
    """Several blocks of points and of places give what one gives."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, *map(float, x), 1.0) for i, x in enumerate(rng.random((60, 3)))], "id long, x double, y double, z double, w double")
    one = {r.id: r for r in cluster.mean_shift(df, 0.6).collect()}
    monkeypatch.setattr(cluster, "SMALL", 20)
    for r in cluster.mean_shift(df, 0.6).collect():
        assert np.allclose(r[1:], one[r.id][1:], atol=1e-9)
