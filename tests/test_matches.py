"""Matching files against what was written, and operators that SQL cannot say against plain versions."""

import heapq
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelab.functions import rank
from shapelab.operators import cluster, fit, graph, skew, spatial
from shapelab.plans import descriptors, iterative, matching, registry, training
from shapelab.sources import arrays, matches, ply

DIR = "/root/testdata/sf0.001"


def test_text_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("chair1 chair2 lamp\nA B C\n")
    assert [tuple(r) for r in matches.read_triplets(spark, str(tmp_path / "t.txt")).orderBy("triplet_id").collect()] == [(1, "chair1", "chair2", "lamp"), (2, "A", "B", "C")]
    (tmp_path / "bad.txt").write_text("A B\n")
    with pytest.raises(Exception, match="not a triplet"):
        matches.read_triplets(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "p.txt").write_text("2\n3 5 6 7\n1 9\n1 1\n1 0\n")
    patches, edges = matches.read_patches(spark, str(tmp_path / "p.txt"))
    assert sorted((r.patch_id, r.pos, r.point_id) for r in patches.collect()) == [(0, 0, 5), (0, 1, 6), (0, 2, 7), (1, 0, 9)]
    assert sorted((r.patch_id, r.neighbour) for r in edges.collect()) == [(0, 1), (1, 0)]
    eye = "1 0 0 0\n0 1 0 0\n0 0 1 0\n"
    (tmp_path / "v.txt").write_text("3\n0 1 0.5\n" + eye + "1 2 -1.#IND\n" + eye + "2 3 1\n" + eye.replace("0 1 0 0", "0 nan 0 0"))
    votes = matches.read_votes(spark, str(tmp_path / "v.txt")).collect()
    assert [(v.vote_id, v.src_seg, v.tgt_seg, v.weight, v.affine[5]) for v in votes] == [(0, 0, 1, 0.5, 1.0)]
    (tmp_path / "m.txt").write_text("2 0.25\n" + eye + eye.replace("1", "2"))
    assert [(m.mode_id, m.sigma, m.affine[0]) for m in matches.read_modes(spark, str(tmp_path / "m.txt")).orderBy("mode_id").collect()] == [(0, 0.25, 1.0), (1, 0.25, 2.0)]
    (tmp_path / "a.txt").write_text(eye + "0.1 0.2\n0.3\n")
    a = matches.read_alignment(spark, str(tmp_path / "a.txt")).first()
    assert len(a.affine) == 12 and a.distances == [0.1, 0.2, 0.3]
    (tmp_path / "b.txt").write_text(eye + "0.1 nan\n")
    with pytest.raises(Exception, match="not finite"):
        matches.read_alignment(spark, str(tmp_path / "b.txt")).collect()
    (tmp_path / "e.txt").write_text("1\n4\n2 7 8\n1 3\n")
    assert sorted((r.element_id, r.mode_id, r.side, r.patch_id) for r in matches.read_elements(spark, str(tmp_path / "e.txt")).collect()) == [(0, 4, "source", 7), (0, 4, "source", 8), (0, 4, "target", 3)]
    w = spark.createDataFrame([(1, 0.5), (0, 2.0)], "at int, value double")
    matches.write_lines(w, str(tmp_path / "w"), ["value"], ["at"])
    assert [r.value for r in matches.read_weights(spark, str(tmp_path / "w")).orderBy("path", "at").collect()] == [2.0, 0.5]


def test_binary_files(spark, tmp_path):
    x = np.zeros(3, matches.CURVATURE)
    x["k1"], x["d2"] = [1, 2, 3], np.arange(9).reshape(3, 3)
    (tmp_path / "c.txt").write_bytes(np.int32(3).tobytes() + x.tobytes())
    c = matches.read_curvature(spark, str(tmp_path / "c.txt")).orderBy("point_id").collect()
    assert [r.k1 for r in c] == [1, 2, 3] and c[1].d2 == [3, 4, 5]
    (tmp_path / "s.txt").write_bytes(np.arange(6, dtype="<f8").tobytes())
    assert [tuple(r)[1:] for r in matches.read_saliency(spark, str(tmp_path / "s.txt")).orderBy("point_id").collect()] == [(0, 0, 1, 2), (1, 3, 4, 5)]
    folder = tmp_path / "triplet" / "12"
    folder.mkdir(parents=True)
    (folder / "pdAB-2.txt").write_bytes(arrays.matrix_bytes(np.ones((2, 3))))
    (folder / "sdAC-2.txt").write_bytes(np.int32(2).tobytes() + np.ones(2).tobytes())
    for k in ("asAB", "atAB"):
        (folder / f"{k}-2.txt").write_bytes(np.array([2, 1, 5, 2, 6, 7], "<i4").tobytes())
    for k in ("usAB", "utAC"):
        (folder / f"{k}-2.txt").write_bytes(np.array([2, 0, 4], "<i4").tobytes())
    got = matches.learning_set(spark, str(tmp_path))
    r = got["as"].orderBy("row").collect()
    assert [(x.triplet_id, x.pair, x.sigma, x.ids) for x in r] == [(12, "AB", "-2", [6]), (12, "AB", "-2", [7, 8])]
    assert got["us"].first().ids == [1, 5] and got["pd"].count() == 2 and got["sd"].first().pair == "AC"
    samples = spark.createDataFrame([(1, k, float(k), 0.0, 0.0, 0.0, 1.0, 0.0, 7 + k, 0.5) for k in (1, 0)], "shape_id int, point_id int, x float, y float, z float, nx float, ny float, nz float, face_id int, radius float")
    (tmp_path / "one.ply").write_bytes(bytes(matches.sample_files(samples).first().content))
    back = ply.read_samples(spark, str(tmp_path / "one.ply")).orderBy("point_id").collect()
    assert [(r.x, r.face_id, r.radius) for r in back] == [(0.0, 7, 0.5), (1.0, 8, 0.5)]
    (tmp_path / "curve-2.ply").write_bytes(ply.ply_bytes(np.ones((2, 6))))
    assert {r.curve_type for r in matches.read_curves(spark, str(tmp_path)).collect()} == {"boundary"}
    points = spark.createDataFrame([(1, 0), (1, 1)], "shape_id int, point_id int")
    assert [r.k for r in matches.with_features(points, spark.createDataFrame([(1, 1, 9)], "shape_id int, point_id int, k int")).orderBy("point_id").collect()] == [None, 9]


def cloud(spark, n, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, 3)) ** 3
    return x, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, x double, y double, z double")


def test_nearest_on_grid(spark):
    x, p = cloud(spark, 120)
    got = {}
    for r in spatial.nearest_on_grid(p, p.withColumnRenamed("id", "query"), 3, 0.05).collect():
        got.setdefault(r.query, {})[r.rank] = r.id
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        assert [got[i][k] for k in (1, 2, 3)] == [j for j in np.argsort(d, kind="stable") if j != i][:3]
    assert spatial.nearest_on_grid(p.where("false"), p.withColumnRenamed("id", "query"), 3, 0.05).count() == 0


def test_keep_first(spark):
    r = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 80, (120, 2))] + [(i, i + 1) for i in range(80, 110)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    kept = []
    for i in range(111):
        if not any(j in near.get(i, ()) for j in kept if j != i):
            kept.append(i)
    got = graph.keep_first(spark.range(111).withColumnRenamed("id", "node"), spark.createDataFrame(pairs, "a long, b long"))
    assert sorted(r.node for r in got.collect()) == kept


def test_components_and_joins_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(graph, "SENT", 0)
    monkeypatch.setattr(skew, "LEAST", 16)
    edges = [(1000, i) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(40)] + [(None, 5), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(300)}, 1000: 0, **{2000 + i: 2000 for i in range(41)}}
    many = spark.createDataFrame([(1, i) for i in range(200)] + [(2, i) for i in range(5)] + [(None, 3)], "k int, v int")
    one = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "k int, w string")
    hot = skew.hot_keys(many, "k")
    assert [r.k for r in hot.collect()] == [1]
    for how in ("inner", "left"):
        assert sorted(map(str, skew.spread_join(many, one, "k", hot, how).select("k", "v", "w").collect())) == sorted(map(str, many.join(one, "k", how).select("k", "v", "w").collect()))


def test_ranks_with_an_outlier(spark):
    v = [float(i) for i in range(3000)] + [1e15, -1e15]
    got = {r.v: r.before for r in rank.value_ranks(spark.createDataFrame([(x,) for x in v], "v double"), [], "v").collect()}
    assert all(got[x] == k for k, x in enumerate(sorted(v)))


def test_kmeans_settles_as_lloyd_does(spark):
    p = iterative.vectors(spark, DIR).select("id", "v")
    rows = sorted((r.id, r.v) for r in p.collect())
    x = np.array([r[1] for r in rows])
    centres = [x[0]]
    while len(centres) < 4:
        d = np.min([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centres], axis=0)
        centres.append(x[int(d.argmax())])
    centres = np.array(centres)
    while True:
        own = np.argmin([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centres], axis=0)
        new = np.array([x[own == k].mean(axis=0) for k in range(4)])
        if np.allclose(new, centres, atol=1e-12):
            break
        centres = new
    got = {r.id: r.cluster for r in cluster.kmeans(p, 4)[0].collect()}
    assert [got[r[0]] for r in rows] == own.tolist()
    with pytest.raises(RuntimeError):
        cluster.kmeans(p, 4, steps=1)


def test_mean_shift_settles_and_modes_merge(spark):
    x, p = cloud(spark, 80, 5)
    got = {r.id: r for r in cluster.merged_modes(cluster.mean_shift(p.withColumn("w", F.lit(1.0)), 1.0), 0.01).collect()}
    places = []
    for at in x:
        while True:
            new = x[np.sqrt(((x - at) ** 2).sum(axis=1)) <= 1.0].mean(axis=0)
            if ((new - at) ** 2).sum() <= 1e-8:
                break
            at = new
        places.append(at)
    assert all(np.allclose([got[i].x, got[i].y, got[i].z], places[i], atol=1e-3) for i in range(len(x)))
    assert all(got[got[i].mode].mode == got[i].mode <= i for i in range(len(x)))


def test_shortest_paths_as_dijkstra(spark):
    edges = [(i, i + 1, 1.0) for i in range(30)] + [(0, 10, 20.0), (5, 25, 3.0)]
    both = edges + [(b, a, w) for a, b, w in edges]
    d, todo = {}, [(0.0, 0)]
    while todo:
        w, n = heapq.heappop(todo)
        if n not in d:
            d[n] = w
            todo += [(w + k, b) for a, b, k in both if a == n]
            heapq.heapify(todo)
    got = cluster.shortest_paths(spark.createDataFrame(both, "src long, dst long, weight double"), spark.createDataFrame([(0,)], "node long"), 100.0)
    assert {r.node: r.d for r in got.collect()} == d and max(d.values()) > 12


def test_icp_from_afar(spark):
    x, p = cloud(spark, 150, 7)
    moved = x * 1.3 + np.array([5.0, -3.0, 2.0])
    q = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(moved)], "id long, x double, y double, z double")
    t = cluster.affine_icp(p, q, 0.5)
    assert np.allclose(x @ t[:, :3].T + t[:, 3], moved, atol=1e-6)


def test_affine_parts_and_boxes(spark):
    from itertools import product

    r = np.random.default_rng(2)
    q, _ = np.linalg.qr(r.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    a = np.concatenate([q @ np.diag([1.5, 0.7, 2.0]), [[1.0], [2.0], [3.0]]], axis=1)
    d = matching.decomposed(spark.createDataFrame([(1, a.ravel().tolist())], "id long, a array<double>")).first()
    x, y, z, w = d.q
    back = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    assert d.t == [1, 2, 3] and w >= 0 and np.allclose(back, q, atol=1e-6) and np.allclose(d.s, [1.5, 0.7, 2.0])
    corners = np.array(list(product([0, 4], [0, 2], [0, 1]))) @ q.T
    p = spark.createDataFrame([(1, *map(float, c)) for c in corners], "k int, x double, y double, z double")
    assert abs(matching.oriented_boxes(p, "k", 0.01).first().volume - 8) < 1e-9


def test_fit_is_the_minimum(spark):
    r = np.random.default_rng(4)
    gap = r.normal(size=(200, 3)) + [0.8, 0.2, -0.9]
    rows = spark.createDataFrame([(p, g.tolist(), float(1 + i % 2), 0.5) for p in ("a", "b") for i, g in enumerate(gap)], "problem string, gap array<double>, c1 double, c2 double").cache()
    got = fit.fit(rows, {"a": 0.01, "b": 20.0, "none": 1.0}, 3)

    def cost(w, penalty):
        p = 1 / (1 + np.exp(-gap @ w))
        c1 = 1 + np.arange(200) % 2
        return (-c1 * np.log(p) - 0.5 * np.log(1 - p)).sum() + penalty * w.sum()

    for name, penalty in (("a", 0.01), ("b", 20.0)):
        w, v = got[name]
        assert (w >= fit.LOWEST).all() and abs(cost(w, penalty) - v) < 1e-6
        near = [np.maximum(w + np.array(s) * e, fit.LOWEST) for s in itertools.product((-1, 0, 1), repeat=3) for e in (1e-3, 0.1, 1.0)]
        grid = [np.array(g) for g in itertools.product(np.linspace(0, 3, 13), repeat=3)]
        assert all(v <= cost(u, penalty) + 1e-9 for u in near + grid)
    assert got["none"][0].tolist() == [1, 1, 1] and got["a"][0][2] < 1e-6


def test_learned_weights_beat_equal_ones(spark):
    rows = training.learn_map(spark, DIR).collect()
    assert {(r.fold, r["lambda"]) for r in rows} == set(itertools.product(training.FOLDS, training.LAMBDAS))
    assert all(r.w_price >= 0 and 0 <= r.train <= 1 and (r.test is None) == (r.fold == "all") for r in rows)
    best = training.best_penalty(spark, DIR).collect()
    assert len(best) == len({r.dataset for r in rows})


def test_thinning_keeps_apart(spark):
    o = {r.id: r for r in descriptors.oriented(spark, DIR).collect()}
    kept = [r.id for r in matching.poisson_thinning(spark, DIR).orderBy("id").collect()]
    want = []
    for i in sorted(o):
        close = lambda j: sum((o[i][c] - o[j][c]) ** 2 for c in "xyz") <= matching.R**2 and sum(o[i].n[c] * o[j].n[c] for c in "xyz") > 0  # noqa: E731, B023
        if not any(close(j) for j in want):
            want.append(i)
    assert kept == want


def test_queries_without_sql_give_rows(spark):
    for name in ("segment_boxes", "affine_parts", "icp"):
        assert registry.queries()[name](spark, DIR).count() > 0
