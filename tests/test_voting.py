"""Votes, modes and pruning against step-by-step numpy versions."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelab.operators import modes, rtree, voting
from shapelab.plans.voting import nearest_both_ways

POINTS = "seg long, id long, v array<double>, n array<double>"


def shape(seed: int, segs: int, n: int):
    r = np.random.default_rng(seed)
    rows, base = [], np.random.default_rng(1).normal(0, 1, (segs, 40, 3)) * [1.0, 0.6, 0.3]
    for s in range(segs):
        turn = np.linalg.qr(np.eye(3) + 0.2 * r.normal(0, 1, (3, 3)))[0]
        pts = (base[s][:n] + r.normal(0, 0.02, (n, 3))) @ turn.T * (1 + 0.1 * r.random()) + r.normal(0, 1, 3)
        nrm = pts - pts.mean(axis=0)
        nrm /= np.linalg.norm(nrm, axis=1)[:, None]
        rows += [(s, 1000 * s + i, pts[i].tolist(), nrm[i].tolist()) for i in range(n)]
    return rows


def brute_votes(source, target, radius, steps):
    def group(rows):
        out = {}
        for s, i, v, n in sorted(rows, key=lambda r: (r[0], r[1])):
            out.setdefault(s, []).append((v, n))
        return {s: tuple(np.array(x) for x in zip(*g, strict=True)) for s, g in out.items() if len(g) >= voting.LEAST}

    def frame(p):
        o = p - p.mean(axis=0)
        u, sv, _ = np.linalg.svd(o.T, full_matrices=False)
        axes = u.T
        t = axes @ o.T
        axes = axes * np.where(t.max(axis=1) + t.min(axis=1) < 0, -1, 1)[:, None]
        parts = np.array([sv[0] - sv[1], 2 * (sv[1] - sv[2]), 3 * sv[2]]) / sv.sum()
        return axes, np.prod(np.maximum(t.max(axis=1) - t.min(axis=1), radius)), parts

    def rotation(m):
        u, _, vt = np.linalg.svd(m)
        if np.linalg.det(u @ vt) < 0:
            u[:, 2] *= -1
        return u @ vt

    a, b, out = group(source), group(target), {}
    for s, (sp, sn) in a.items():
        for t, (tp, tn) in b.items():
            (sa, sv, sq), (ta, tv, tq) = frame(sp), frame(tp)
            if sv > tv * 100 or sv < tv / 100 or (sq > tq * 5).any() or (sq < tq / 5).any():
                continue
            for start in range(5):
                c, d = [(1, 0), (0, 1), (-1, 0), (0, -1)][start % 4]
                m = np.array([[c, 0, d], [0, 1, 0], [-d, 0, c]], float) if start < 4 else ta.T @ sa
                x = sp @ m.T
                scale = np.linalg.norm(tp - tp.mean(axis=0), axis=0) / np.linalg.norm(x - x.mean(axis=0), axis=0)
                scale[(scale < 0.1) | (scale > 10)] = 1
                m = scale[:, None] * m
                shift = tp.mean(axis=0) - m @ sp.mean(axis=0)
                for _ in range(steps):
                    x, y = sp @ m.T + shift, sn @ rotation(m).T
                    d2 = ((x[:, None] - tp[None]) ** 2).sum(axis=2)
                    hit = d2.argmin(axis=1)
                    dist = np.sqrt(d2.min(axis=1))
                    keep = (dist < 5 * np.sort(dist)[len(dist) // 2]) & ((y * tn[hit]).sum(axis=1) > 0)
                    if not keep.any():
                        break
                    p, q = x[keep], tp[hit][keep]
                    fit = np.linalg.lstsq(p - p.mean(axis=0), q - q.mean(axis=0), rcond=None)[0].T
                    m, shift = fit @ m, fit @ (shift - p.mean(axis=0)) + q.mean(axis=0)
                out[s, t, start] = np.concatenate([m, shift[:, None]], axis=1).ravel()
    return out


def test_votes_step_by_step(spark):
    source, target = shape(2, 4, 36), shape(3, 4, 33)
    source += [(9, 9000 + i, [0.0, 0.0, float(i)], [0.0, 0.0, 1.0]) for i in range(voting.LEAST - 1)]
    a, b = (spark.createDataFrame(x, POINTS) for x in (source, target))
    some, other = voting.sample(a), voting.sample(b)
    state = voting.begun(voting.similar_pairs(voting.frames(some, 0.1), voting.frames(other, 0.1)))
    got = {(r.s, r.t, r.start): np.array(r.a) for r in voting.icp(state, some, voting.tree_of(other), 3).collect()}
    want = brute_votes(source, target, 0.1, 3)
    assert set(got) == set(want) and len(want) >= 40
    for k, v in want.items():
        assert np.allclose(got[k], v, atol=1e-6), k
    near = {r.vote: r for r in voting.matched_distances(state, some, voting.tree_of(other)).collect()}
    assert len(near) == len(want) and all(r.position > 0 and r.n == 36 for r in near.values())


def test_no_votes(spark):
    none = spark.createDataFrame([], POINTS)
    assert voting.votes(none, spark.createDataFrame(shape(2, 1, 30), POINTS), 0.1).count() == 0


def test_an_exact_copy_settles(spark):
    """A moved copy is found, and no step is taken after its transform stays."""
    rows = shape(2, 1, 40)
    moved = [(s, i, (np.array(v) + [0.5, -1, 2]).tolist(), n) for s, i, v, n in rows]
    a, b = (spark.createDataFrame(x, POINTS) for x in (rows, moved))
    first = voting.begun(voting.similar_pairs(voting.frames(a, 0.1), voting.frames(b, 0.1))).where("start = 0")
    (found,) = (np.array(r.a).reshape(3, 4) for r in voting.icp(first, a, voting.tree_of(b)).collect())
    assert np.allclose(found, np.concatenate([np.eye(3), [[0.5], [-1], [2]]], axis=1), atol=1e-8)


def brute_shift(rows, fixed=None):
    """rows: id, v, w of one group."""
    ids, v, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    if len(ids) <= modes.FEW:
        order = sorted(range(len(ids)), key=lambda i: (-w[i], ids[i]))
        return {int(ids[i]): (int(ids[i]), order.index(i)) for i in range(len(ids))}

    def near(c):
        d = np.sqrt(((v - c) ** 2).sum(axis=1))
        order = np.lexsort((ids, d))
        return order, d

    def climb(c):
        for _ in range(modes.STEPS):
            order, d = near(c)
            if fixed is None:
                order = order[: modes.MOST]
                over = np.flatnonzero(np.cumsum(w[order]) > modes.ENOUGH)
                order = order[: over[0] + 1] if len(over) else order
                band = d[order[-1]]
            else:
                order, band = order[d[order] <= fixed], fixed
            new = (w[order, None] * v[order]).sum(axis=0) / w[order].sum() if len(order) and w[order].sum() > 0 else c
            stands = np.sqrt(((new - c) ** 2).sum()) <= band * modes.SETTLE
            c = new
            if stands:
                return c, band
        return None

    mode, bands, dims = {}, {}, v.shape[1]
    for i in range(len(ids)):
        c, band = climb(v[i])
        offset = 2 * band / dims**0.5
        unit = np.array([zlib.crc32(f"{{a, {ids[i]}}}:{d}".encode()) % (1 << 20) / ((1 << 20) - 1) * 2 - 1 for d in range(dims)])
        again, _ = climb(c + offset * unit)
        if np.sqrt(((again - c) ** 2).sum()) > band * 0.5:
            continue
        order, d = near(c)
        inside = order[d[order] <= band * (1 + 1e-9)]
        inside = inside if len(inside) else order[:1]
        best = inside[0]
        for j in inside:
            if w[j] > w[best]:
                best = j
            if w[j] > modes.ENOUGH:
                break
        mode[int(ids[i])], bands[int(ids[i])] = int(ids[best]), band
    at = {int(i): k for k, i in enumerate(ids)}
    kept = []
    for m in sorted({m for m in mode.values() if m in bands}, key=lambda m: (-w[at[m]], m)):
        if all(np.sqrt(((v[at[m]] - v[at[k]]) ** 2).sum()) >= max(bands[m], bands[k]) for k in kept):
            kept.append(m)
    return {int(i): (mode[int(i)], kept.index(mode[int(i)])) if mode.get(int(i)) in kept else (None, None) for i in ids}


@pytest.mark.parametrize("fixed", [None, 0.35])
def test_mean_shift(spark, fixed):
    r = np.random.default_rng(3)
    centres = r.normal(0, 1, (4, 9))
    v = np.array([centres[i % 4] + r.normal(0, 0.06, 9) for i in range(80)])
    w = r.random(80) / 100
    w[:8] *= 12
    w /= w.sum()
    rows = [("a", i, v[i].tolist(), float(w[i])) for i in range(80)] + [("b", i, [float(i)] * 9, 0.25) for i in range(4)]
    got = modes.mean_shift(spark.createDataFrame(rows, "key string, id long, v array<double>, w double"), 9, fixed)
    found = {(x.key, x.id): (x.mode, x.rank) for x in got.collect()}
    want = {(k, i): m for k in "ab" for i, m in brute_shift([x[1:] for x in rows if x[0] == k], fixed).items()}
    assert found == want
    assert len({m for (k, _), (m, _) in want.items() if k == "a" and m is not None}) > (fixed is None)


def test_pruning_by_priority(spark):
    """A light mode near a dropped one stays; the pinned one comes first and its scales don't count."""
    one = [0.0, 0.0, 0.0, 1.0]
    rows = [
        (1, 1, True, 0.0, [0.0, 0.0, 0.0], one, [9.0, 1.0, 1.0]),
        (1, 2, False, 5.0, [1.0, 0.0, 0.0], one, [1.0, 1.0, 1.0]),
        (1, 3, False, 4.0, [1.15, 0.0, 0.0], one, [1.0, 1.0, 1.0]),
        (1, 4, False, 3.0, [1.3, 0.0, 0.0], one, [1.0, 1.0, 1.0]),
        (1, 5, False, 9.0, [5.0, 0.0, 0.0], one, [6.0, 1.0, 1.0]),
        (1, 6, False, 2.0, [1.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [1.0, 1.0, 1.0]),
        (1, 7, False, 1.0, [1.0, 0.0, 0.0], one, [1.2, 1.0, 1.0]),
        (2, 3, False, 4.0, [1.15, 0.0, 0.0], one, [1.0, 1.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, "key int, id int, pinned boolean, weight double, t array<double>, q array<double>, s array<double>")
    got = {(r.key, r.id): r.rank for r in modes.pruned(df, 0.1).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 4): 2, (1, 6): 3, (1, 7): 4, (2, 3): 0}
    assert modes.pruned(df.where("false"), 0.1).count() == 0


def test_both_ways_of_two_pairs(spark):
    """Pairs don't mix, and hubs are counted for each transform."""
    line = lambda seg, xs, up: [(seg, 100 * seg + i, [x, 0.0, 0.0], [0.0, 0.0, up]) for i, x in enumerate(xs)]
    source = spark.createDataFrame(line(1, [0.0] * 11 + [5.0], 1.0) + line(2, [0.0, 1.0], 1.0), POINTS)
    target = spark.createDataFrame(line(1, [0.1, 5.2], 1.0) + line(2, [1.1, 0.2], -1.0), POINTS)
    still = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    over = [1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0]
    flip = [1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0]
    t = spark.createDataFrame([(1, 1, still, eye), (2, 2, still, eye), (3, 2, flip, over)], "mode int, seg long, a array<double>, r array<double>")
    got = {(r.mode, r.forward, r.id): r.hit for r in nearest_both_ways(source, target, t).collect()}
    assert got == {(1, True, 111): 101, (1, False, 100): 100, (1, False, 101): 111, (3, True, 200): 201, (3, True, 201): 200, (3, False, 200): 201, (3, False, 201): 200}


def test_a_crowded_place_is_dealt_over_leaves(spark):
    """With half of the points in one place, no leaf has over a twentieth of the rows."""
    r = np.random.default_rng(1)
    v = np.concatenate([np.zeros((800, 3)), r.normal(0, 1, (800, 3))])
    tree = rtree.build(spark.createDataFrame([("a", i, x.tolist(), 0.0) for i, x in enumerate(v)], "key string, id long, v array<double>, w double"), 3)
    assert tree.levels[0].agg(F.max(F.size("kids"))).first()[0] * 20 <= len(v)
