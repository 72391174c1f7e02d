"""Findings of round 4: every point, neighbour and segment takes part."""

import duckdb
import numpy as np

from shapelab.operators import cluster, rtree, spatial, voting
from shapelab.plans import registry
from shapelab.plans import voting as plans
from tests.test_voting import POINTS, brute_votes, shape

DIR = "/root/testdata/sf0.001"


def test_every_point_has_a_high_distinctness(spark):
    ids = {r[0] for r in spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id").collect()}
    got = registry.queries()["distinct_high"](spark, DIR).collect()
    assert len(got) == len(ids) and {r.query for r in got} == ids


def test_bounds_hold_among_equal_points(spark, monkeypatch):
    """Half of the points lie in one place, so that ids alone say which are the nearest; few distances are kept, and no sample is read."""
    r = np.random.default_rng(9)
    v = np.abs(r.normal(0, 1, (600, 5)))
    v[::2] = v[0]
    u = r.random((600, 3))
    rows = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(v, u, strict=True))], "id long, v array<double>, u array<double>")
    monkeypatch.setattr(spatial, "SAMPLE", 8)
    monkeypatch.setattr(spatial, "PIECE", 16)
    for k, errors in ((60, 5.0), (400, 5.0), (60, 0.0), (700, 5.0)):
        monkeypatch.setattr(spatial, "ERRORS", errors)
        got = {x.query: x["mean"] for x in spatial.means_of_nearest(rows, rows, k, lambda d, gap: d + gap).collect()}
        assert len(got) == 600
        for i in range(0, 600, 7):
            d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
            near = [j for j in np.lexsort((np.arange(600), d)) if j != i][:k]
            assert np.isclose(got[i], np.mean([d[j] + np.sqrt(((u[j] - u[i]) ** 2).sum()) for j in near]), atol=1e-9)


def test_every_point_has_a_distinctness(spark):
    ids = {r[0] for r in spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id").collect()}
    got = registry.queries()["distinctness"](spark, DIR).collect()
    assert len(got) == len(ids) and {r.query for r in got} == ids


def test_images_have_all_neighbours(spark, tmp_path):
    """More than a thousand neighbours of a point, as many as there are, some of them at its place."""
    r = np.random.default_rng(4)
    v = r.normal(0, 0.02, (1300, 8))
    v[5:9] = v[4]
    v[11, 0] = np.nan
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for x in registry.queries()["spin_image"](spark, str(tmp_path)).collect():
        got.setdefault(x.id, {})[x.bin] = x.v
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet' where vec_id <> 11")
    want = {}
    for i, b, share in duck.execute(registry.oracle_sql()["spin_image"]).fetchall():
        want.setdefault(i, {})[b] = share
    assert got.keys() == want.keys() and len(got) == 1299
    assert all(got[i].keys() == want[i].keys() and all(abs(got[i][b] - x) < 2e-6 for b, x in want[i].items()) for i in want)


def test_boxes_find_the_first_of_the_nearest():
    r = np.random.default_rng(1)
    for n, m in ((21, 40), (700, 500)):
        x, y = r.normal(0, 0.1, (n, 3)), r.normal(0, 0.1, (m, 3))
        y[20:40], x[:9] = y[:20], y[:9]
        p, q, last = voting.Boxes(x), voting.Boxes(y), None
        for k in range(3):
            z = x[p.order] * (1 + 0.1 * k) + 0.02 * k
            last, d = q.nearest(p, z, last)
            all_ = np.sqrt(((z[:, None] - y[None]) ** 2).sum(axis=2))
            assert (last == all_.argmin(axis=1)).all() and np.allclose(d, all_.min(axis=1))


def test_votes_take_all_points_of_large_segments(spark):
    """A segment of over a thousand points was a sample of them."""
    r = np.random.default_rng(6)
    base = r.normal(0, 1, (1300, 3)) * [1.0, 0.6, 0.3]
    rows = []
    for n, shift in ((1300, 0.0), (1200, 0.3)):
        v = base[:n] * (1 + shift / 3) + shift + r.normal(0, 0.02, (n, 3))
        rows.append([(0, i, v[i].tolist(), (base[i] / np.linalg.norm(base[i])).tolist()) for i in range(n)])
    got = {(x.s, x.t, x.start): np.array(x.a) for x in voting.votes(*(spark.createDataFrame(x, POINTS) for x in rows), 0.1).collect()}
    want = brute_votes(*rows, 0.1, voting.STEPS)
    assert got.keys() == want.keys() and len(want) == 5
    assert all(np.allclose(got[k], v, atol=1e-4) for k, v in want.items())


def test_segments_that_no_task_holds(spark, monkeypatch):
    """Keys of segments beyond HELD points take steps over all keys at once; both ways give the same, as do the distances."""
    a, b = (spark.createDataFrame(shape(k, 2, n), POINTS) for k, n in ((2, 36), (3, 33)))
    state = voting.stored(voting.begun(voting.similar_pairs(voting.frames(a, 0.1), voting.frames(b, 0.1))).where("start < 2"))
    held = {x.vote: np.array(x.a) for x in voting.icp_of_pairs(state, a, b, 1).collect()}
    far = {x.vote: (x.position, x.normal, x.n) for x in voting.distances_of_pairs(state, a, b).collect()}
    monkeypatch.setattr(voting, "HELD", 34)
    assert len(held) == state.count() >= 2
    assert all(np.allclose(x.a, held[x.vote], atol=1e-9) for x in voting.icp_of_pairs(state, a, b, 1).collect())
    other = voting.distances_of_pairs(state, a, b).collect()
    assert len(other) == len(far) == len(held) and all(np.allclose((x.position, x.normal, x.n), far[x.vote]) for x in other)


def test_votes_that_make_modes_take_all_points(spark, tmp_path):
    """The votes behind `vote_modes` are alignments of whole segments, also of over a thousand points."""
    r = np.random.default_rng(8)
    v = r.normal(0, 1, (2300, 8)) * [0.2, 0.12, 0.06, 1, 1, 1, 1, 1]
    v[1::2, :6] = v[::2, :6]
    v[1::2, :3] = v[1::2, :3] * 1.1 + r.normal(0, 0.004, (1150, 3)) + 0.05
    spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    n = v[:, 3:6] / np.linalg.norm(v[:, 3:6], axis=1)[:, None]
    want = brute_votes(*([(0, i, v[i, :3], n[i]) for i in range(k, 2300, 2)] for k in (0, 1)), plans.R, voting.STEPS)
    got = {(x.s, x.t, x.start): np.array(x.a) for x in plans.vote_clusters(spark, str(tmp_path))[0].collect()}
    assert got and got.keys() <= want.keys() and all(np.allclose(a, want[k], atol=1e-4) for k, a in got.items())


def test_moved_points_stay_in_tasks(spark, monkeypatch):
    """Distances of votes and the alignment of whole shapes made a row of each moved point, for each vote and step, and shuffled it."""
    rows = shape(2, 2, 36)
    a, b = (spark.createDataFrame([(*x, 0.1 * (x[1] % 9)) for x in y], f"{POINTS}, value double") for y in (rows, shape(3, 2, 33)))
    state = voting.stored(voting.begun(voting.similar_pairs(voting.frames(a, 0.1), voting.frames(b, 0.1))))
    want = {x.vote: x.position / plans.R + x.normal for x in voting.matched_distances(state, a, voting.tree_of(b)).collect()}

    def fail(*x, **k):
        raise AssertionError("moved points are searched as rows")

    monkeypatch.setattr(rtree, "search", fail)
    assert plans.global_vote(a, b).count() == 1
    got = {x.vote: x for x in plans.vote_distances(state, a, b, plans.R).collect()}
    assert got.keys() == want.keys() and all(x.spd >= want[k] - 1e-9 for k, x in got.items())


def test_paths_of_every_point(spark, monkeypatch):
    """Tiles of several leaves, swept a few sources at once, give the lengths of plain rounds."""
    r = np.random.default_rng(12)
    x = np.concatenate([r.normal(0, 0.08, (500, 3)), r.uniform(-0.3, 0.3, (150, 3))])
    x[5], x[20] = x[0], 9.0
    p = spark.createDataFrame([(3 * i, *map(float, v)) for i, v in enumerate(x)], "id long, x double, y double, z double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    path = np.where(d <= 0.06, d, np.inf)
    for k in range(len(x)):
        path = np.minimum(path, path[:, k, None] + path[None, k])
    path[path > 0.3] = np.inf
    some = np.isfinite(path)
    want = {3 * i: (n, t / n) for i, (n, t) in enumerate(zip(some.sum(axis=1), np.where(some, path, 0).sum(axis=1)))}
    monkeypatch.setattr(cluster, "SWEPT", 40)
    conf = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (conf, "1"):  # one leaf in a tile, and all of them
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        monkeypatch.setattr(rtree, "FAN", 64 if parts == conf else 16)
        got = {y.source: (y.reached, y["mean"]) for y in cluster.path_means(p, p, 0.06, 0.3).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", conf)
        assert got.keys() == want.keys() and all(got[k][0] == n and abs(got[k][1] - m) < 1e-12 for k, (n, m) in want.items())


def test_every_point_is_a_source(spark):
    ids = {r[0] for r in spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id").collect()}
    got = registry.queries()["geodesic"](spark, DIR).collect()
    assert len(got) == len(ids) and {r.source for r in got} == ids and max(r.centrality for r in got) == 1.0
