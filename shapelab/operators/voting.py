"""Alignments of segments by affine iterated closest points: every pair and start is a key, and all keys take a step in one job.

All points of a segment take part. A pair of segments of up to HELD points takes all of its steps in one task (`icp_of_pairs`), where packed boxes find the nearest points.
For shapes of any size (`icp`) a step finds the nearest target point of each moved source point (`rtree`), rejects those that are far or face
another way, adds up 22 moments by key, and solves a key's normal equations from them in a task. Keys whose
transform stays are settled and take no further step. Transforms are 12 numbers, the rows of a 3 x 4 matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from shapelab.operators import rtree
from shapelab.session import cut, stored

#: Points that a segment needs; steps; a match may be so many times as far as the upper median; starts.
LEAST, STEPS, REJECT, STARTS = 20, 20, 5.0, 5
#: Points of a segment up to which a task holds it; points of a box.
HELD, BOX = 1 << 19, 32
#: Bounds of the ratios of volumes and of shape parts; of a scale.
VOLUMES, PARTS, SCALES = 100.0, 5.0, (0.2, 5.0)
AXES = range(3)
PAIRS = [(i, j) for i in AXES for j in AXES]


def enough(points: DataFrame) -> DataFrame:
    """The points of segments of LEAST points or more, with the segment's size. points: seg, id, v, n (arrays of three)."""
    size = points.groupBy("seg").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= LEAST)
    return points.join(size, "seg")


def _cov(sums: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sums.reshape(-1, 3, 3) - a[:, :, None] * b[:, None, :] / n[:, None, None]


def frames(points: DataFrame, radius: float) -> DataFrame:
    """(seg, size, mean, spread, axes, volume, parts): of each segment the mean, the sum of the squares about it (3 x 3), the principal axes as rows (longest first, pointing to where the box reaches further), the volume of the box and the linear, planar and spherical part.

    Sums are aggregates; a task takes the axes of the nine numbers of a segment; the ends along the axes are a second aggregate."""
    sums = points.groupBy("seg").agg(F.count(F.lit(1)).alias("size"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in AXES], *[F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"s{i}{j}") for i, j in PAIRS])
    kind = dict(points.dtypes)["seg"]

    def axes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in parts:
            n, s = g["size"].to_numpy(float), g[[f"s{i}" for i in AXES]].to_numpy(float)
            spread = _cov(g[[f"s{i}{j}" for i, j in PAIRS]].to_numpy(float), n, s, s)
            values, vectors = np.linalg.eigh(spread)
            long = np.sqrt(np.maximum(values[:, ::-1], 0))
            whole = np.where(long.sum(axis=1) > 0, long.sum(axis=1), 1)[:, None]
            parts_ = np.stack([long[:, 0] - long[:, 1], 2 * (long[:, 1] - long[:, 2]), 3 * long[:, 2]], axis=1) / whole
            yield pd.DataFrame({"seg": g["seg"], "size": g["size"], "mean": list(s / n[:, None]), "spread": list(spread.reshape(-1, 9)), "axes": list(vectors[:, :, ::-1].transpose(0, 2, 1).reshape(-1, 9)), "parts": list(parts_)})

    f = cut(sums.mapInPandas(axes, f"seg {kind}, size long, mean array<double>, spread array<double>, axes array<double>, parts array<double>"))
    along = [sum((F.col("axes")[3 * k + i] * (F.col("v")[i] - F.col("mean")[i]) for i in AXES), F.lit(0.0)) for k in AXES]
    ends = points.select("seg", "v").join(f.select("seg", "mean", "axes"), "seg").groupBy("seg").agg(*[g(a).alias(f"{name}{k}") for k, a in enumerate(along) for g, name in ((F.min, "lo"), (F.max, "hi"))])
    extent = [F.greatest(F.col(f"hi{k}") - F.col(f"lo{k}"), F.lit(radius)) for k in AXES]
    turn = [F.when(F.col(f"hi{k}") + F.col(f"lo{k}") < 0, -1.0).otherwise(1.0) for k in AXES]
    out = f.join(ends, "seg").withColumn("volume", extent[0] * extent[1] * extent[2])
    return cut(out.withColumn("axes", F.array(*[F.col("axes")[3 * k + i] * turn[k] for k in AXES for i in AXES])).select("seg", "size", "mean", "spread", "axes", "volume", "parts"))


def similar_pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs of frames (s, t) whose volumes and shape parts are alike. Volumes meet by their order of magnitude, so that only those that may be alike do."""
    order = lambda c: F.floor(F.log(c) / F.log(F.lit(VOLUMES)))
    s = source.select(F.struct(*source.columns).alias("s")).withColumn("_o", F.explode(F.array(*[order(F.col("s.volume")) + k for k in (-1, 0, 1)])))
    t = target.select(F.struct(*target.columns).alias("t")).withColumn("_o", order(F.col("t.volume")))
    both = s.join(t, "_o").where((F.col("s.volume") <= F.col("t.volume") * VOLUMES) & (F.col("s.volume") >= F.col("t.volume") / VOLUMES))
    for k in AXES:
        a, b = F.col("s.parts")[k], F.col("t.parts")[k]
        both = both.where((a <= b * PARTS) & (a >= b / PARTS))
    return both.select("s", "t")


def aligned(linear: np.ndarray, s: dict[str, np.ndarray], t: dict[str, np.ndarray]) -> np.ndarray:
    """Transforms that apply `linear`, then bring centres together, and sizes along each axis unless these are flat or differ tenfold."""
    a = np.sqrt(np.maximum(np.einsum("nij,njk,nik->ni", linear, s["spread"], linear), 0))
    b = np.sqrt(np.maximum(np.einsum("nii->ni", t["spread"]), 0))
    scale = np.where((a > 0) & (b > 0), b / np.where(a > 0, a, 1), 1.0)
    scale[(scale < 0.1) | (scale > 10)] = 1.0
    m = scale[:, :, None] * linear
    return np.concatenate([m, (t["mean"] - np.einsum("nij,nj->ni", m, s["mean"]))[:, :, None]], axis=2)


def rotations(m: np.ndarray) -> np.ndarray:
    """The rotation nearest to each 3 x 3 matrix; not finite ones give the identity."""
    ok = np.isfinite(m).all(axis=(1, 2))
    u, _, vt = np.linalg.svd(np.where(ok[:, None, None], m, np.eye(3)))
    u[np.linalg.det(u @ vt) < 0, :, 2] *= -1
    return u @ vt


def _begun(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for g in parts:
        if not len(g):
            continue
        side = lambda p: {c: np.stack(g[f"{p}_{c}"].to_numpy()).reshape(-1, *shape) for c, shape in (("mean", (3,)), ("spread", (3, 3)), ("axes", (3, 3)))}  # noqa: B023, E731
        s, t, k = side("s"), side("t"), g["start"].to_numpy()
        cos, sin = np.round(np.cos(k * np.pi / 2)), np.round(np.sin(k * np.pi / 2))
        linear = np.zeros((len(g), 3, 3))
        linear[:, 1, 1], linear[:, 0, 0], linear[:, 2, 2], linear[:, 0, 2], linear[:, 2, 0] = 1, cos, cos, sin, -sin
        last = k == STARTS - 1
        linear[last] = np.einsum("nji,njk->nik", t["axes"][last], s["axes"][last])
        a = aligned(linear, s, t)
        yield pd.DataFrame({"vote": g["vote"], "s": g["s_seg"], "t": g["t_seg"], "start": g["start"], "a": list(a.reshape(-1, 12)), "r": list(rotations(a[:, :, :3]).reshape(-1, 9)), "first": list(a.reshape(-1, 12))})


def begun(pairs: DataFrame) -> DataFrame:
    """(vote, s, t, start, a, r, first): each pair with its starts, four turns about y and the principal axes on each other. vote numbers them; r is the rotation in a."""
    flat = pairs.select(*[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "st" for c in ("seg", "mean", "spread", "axes")], F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))).alias("start"))
    kind = dict(flat.dtypes)["s_seg"]
    state = f"s {kind}, t {kind}, start int, a array<double>, r array<double>, first array<double>"
    return cut(flat.withColumn("vote", F.xxhash64("s_seg", "t_seg", "start")).mapInPandas(_begun, f"vote long, {state}"))


def moved(state: DataFrame, points: DataFrame) -> DataFrame:
    """(vote, t, q): q has the id, the place (x), and the normal (n) of each point of a key's source segment under its transform."""
    a, r = F.col("a"), F.col("r")
    x = F.array(*[sum((a[4 * i + j] * F.col("v")[j] for j in AXES), F.lit(0.0)) + a[4 * i + 3] for i in AXES])
    n = F.array(*[sum((r[3 * i + j] * F.col("n")[j] for j in AXES), F.lit(0.0)) for i in AXES])
    return state.join(points.select(F.col("seg").alias("s"), "id", "v", "n"), "s").select("vote", "t", F.struct("vote", "id", x.alias("x"), n.alias("n")).alias("q"))


def tree_of(points: DataFrame) -> rtree.Tree:
    """Points of segments, each segment a group, with their normals."""
    return rtree.build(points.select(F.col("seg").alias("key"), "id", "v", F.col("n").alias("w")), 3)


def matches(state: DataFrame, points: DataFrame, tree: rtree.Tree) -> DataFrame:
    """(vote, id, x, target, y, d, cosine): the nearest point of the target segment to each moved point."""
    q = moved(state, points).select(F.col("q").alias("query"), F.col("t").alias("key"), F.col("q.x").alias("at"))
    near = rtree.search(tree, q, 1)
    return near.select("query.vote", "query.id", "query.x", F.col("id").alias("target"), F.col("v").alias("y"), "d", sum((F.col("query.n")[i] * F.col("w")[i] for i in AXES), F.lit(0.0)).alias("cosine"))


def _fitted(a: np.ndarray, first: np.ndarray, n: np.ndarray, sx: np.ndarray, sy: np.ndarray, xx: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(transforms, whether each is done): the least squares fits on moments, after the transforms a; one that isn't finite is `first`."""
    some = np.where(n > 0, n, 1)
    xx, xy = _cov(xx, some, sx, sx), _cov(xy, some, sx, sy)
    fit = np.stack([np.linalg.lstsq(p, q, rcond=1e-10)[0].T for p, q in zip(xx, xy, strict=True)])
    shift = sy / some[:, None] - np.einsum("nij,nj->ni", fit, sx / some[:, None])
    new = np.einsum("nij,njk->nik", fit, a)
    new[:, :, 3] += shift
    new = np.where((n > 0)[:, None, None], new, a)
    bad = ~np.isfinite(new).all(axis=(1, 2))
    done = (n == 0) | bad | (np.abs(new - a).max(axis=(1, 2)) <= 1e-10)
    new[bad] = first[bad]
    return new, done


def _solved(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each key's least squares fit on its moments, after its transform so far."""
    for g in parts:
        if not len(g):
            continue
        a, first = (np.stack(g[c].to_numpy()).reshape(-1, 3, 4) for c in ("a", "first"))
        sx, sy = (g[[f"{c}{i}" for i in AXES]].fillna(0).to_numpy(float) for c in "xy")
        xx, xy = (g[[f"{c}{i}{j}" for i, j in PAIRS]].fillna(0).to_numpy(float) for c in ("xx", "xy"))
        new, done = _fitted(a, first, g["size"].fillna(0).to_numpy(float), sx, sy, xx, xy)
        yield pd.DataFrame({"vote": g["vote"], "s": g["s"], "t": g["t"], "start": g["start"], "a": list(new.reshape(-1, 12)), "r": list(rotations(new[:, :, :3]).reshape(-1, 9)), "first": g["first"], "done": done})


def _product(a: str, b: str) -> list[Column]:
    return [F.sum(F.col(a)[i] * F.col(b)[j]).alias(f"{a}{b}{i}{j}") for i, j in PAIRS]


def icp(state: DataFrame, source: DataFrame, tree: rtree.Tree, steps: int = STEPS) -> DataFrame:
    """The keys' transforms after `steps` steps, or when they stay.

    state: as of `begun`. source: the segments' points; a key has as many matches as its segment has points."""
    by = Window.partitionBy("vote")
    columns, types = state.columns, state.schema.simpleString()[len("struct<") : -1]
    open_, done = state, None
    for _ in range(steps):
        near = matches(open_, source, tree).withColumn("at", F.row_number().over(by.orderBy("d", "id"))).withColumn("n", F.count(F.lit(1)).over(by))
        upper = F.max(F.when(F.col("at") == F.floor(F.col("n") / 2) + 1, F.col("d"))).over(by)
        kept = near.withColumn("far", upper * REJECT).where((F.col("d") < F.col("far")) & (F.col("cosine") > 0))
        sums = kept.groupBy("vote").agg(F.count(F.lit(1)).alias("size"), *[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in "xy" for i in AXES], *_product("x", "x"), *_product("x", "y"))
        step = stored(open_.join(sums, "vote", "left").mapInPandas(_solved, types.replace(":", " ").replace(",", ", ") + ", done boolean"))
        settled = step.where("done").select(columns)
        done = settled if done is None else done.unionByName(settled)
        open_ = step.where("not done").select(columns)
        if open_.isEmpty():
            return done
    return open_ if done is None else done.unionByName(open_)


class Boxes:
    """Points in boxes of BOX neighbouring ones at most, by halves along the longest side."""

    def __init__(self, v: np.ndarray) -> None:
        self.points, self.order, open_, ends = v, np.arange(len(v)), [(0, len(v))], []
        while open_:
            a, b = open_.pop()
            if b - a <= BOX:
                ends.append((a, b))
                continue
            part = self.order[a:b]
            some = v[part]
            half = BOX * -(-(b - a) // (2 * BOX))
            axis = (some.max(axis=0) - some.min(axis=0)).argmax()
            self.order[a:b] = part[np.argpartition(some[:, axis], half - 1)]
            open_ += [(a, a + half), (a + half, b)]
        self.ends = sorted(ends)
        starts = np.array([a for a, _ in self.ends])
        self.lo, self.hi = (f.reduceat(v[self.order], starts) for f in (np.minimum, np.maximum))
        # a table of boxes, filled up with places that are no one's nearest
        self.row = np.full((len(starts), BOX), -1)
        self.row[np.searchsorted(starts, np.arange(len(v)), side="right") - 1, np.arange(len(v)) - np.repeat(starts, np.diff(np.append(starts, len(v))))] = self.order
        self.at = [np.where(self.row < 0, np.inf, v[self.row, j]) for j in AXES]

    def nearest(self, of: Boxes, x: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(hit, d) in the order of `of`'s boxes: of each x the nearest point (ties: the first). x: `of`'s points under some transform; last: hits to begin with, which bound those sought."""
        hit, square = np.empty(len(x), np.int64), np.empty(len(x))
        bound = None if last is None else self._square(x, *self.points[last].T)
        for a, b in of.ends:
            q = x[a:b]
            lo, hi = q.min(axis=0), q.max(axis=0)
            gap = np.maximum(np.maximum(self.lo - hi, lo - self.hi), 0.0)
            far = (gap * gap).sum(axis=1)
            if bound is None:
                gap = np.maximum(np.maximum(self.lo - (lo + hi) / 2, (lo + hi) / 2 - self.hi), 0.0)
                first = (gap * gap).sum(axis=1).argmin()
                most = self._square(q[:, None], *(c[first][None] for c in self.at)).min(axis=1).max()
            else:
                most = bound[a:b].max()
            near = np.flatnonzero(~(far > most * (1 + 1e-9)))
            d = self._square(q[:, None], *(c[near].reshape(1, -1) for c in self.at))
            best, rows = d.argmin(axis=1), self.row[near].ravel()
            hit[a:b], square[a:b] = rows[best], d[np.arange(b - a), best]
            same = d <= square[a:b, None] * (1 + 1e-15)
            if np.count_nonzero(same) > b - a:
                for i in np.flatnonzero(same.sum(axis=1) > 1):
                    j = np.flatnonzero(same[i])
                    j = j[np.sqrt(d[i, j]) == np.sqrt(square[a + i])]
                    hit[a + i] = rows[j].min()
        return hit, np.sqrt(square)

    @staticmethod
    def _square(q: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        a, b, c = x - q[..., 0], y - q[..., 1], z - q[..., 2]
        return a * a + b * b + c * c


def _packed(points: DataFrame, seg: str) -> DataFrame:
    """(seg, seg_v, seg_n): the places and normals of a segment as one array each, in order of ids."""

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by([("id", "ascending"), ("_h", "ascending")]).combine_chunks()
        rows = [pa.array([g.column(c).combine_chunks().flatten()], pa.list_(pa.float64())) for c in "vn"]
        return pa.table({seg: g.column("seg")[:1], f"{seg}_v": rows[0], f"{seg}_n": rows[1]})

    rows = points.select("seg", "id", F.col("v").cast("array<double>"), F.col("n").cast("array<double>"), F.xxhash64("v", "n").alias("_h"))
    return rows.groupBy("seg").applyInArrow(run, f"{seg} {dict(points.dtypes)['seg']}, {seg}_v array<double>, {seg}_n array<double>")


def _of_pairs(state: DataFrame, source: DataFrame, target: DataFrame, run: Callable[..., list], schema: str) -> DataFrame:
    """What `run` makes of each pair's transforms, of arrays of both segments' places and normals; a pair goes to a task with both its segments."""
    names = [c for c in state.columns if c not in ("s", "t")]

    def of_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                held = [row.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 3) for c in ("s_v", "s_n", "t_v", "t_n")]
                rows = row.column("k").to_pylist()[0]
                made = run(rows, *held)
                both = {c: row.column(c).to_pylist()[0] for c in "st"}
                yield from pa.Table.from_pylist([{**k, **both, **m} for k, m in zip(rows, made, strict=True)], kind).to_batches()

    pairs = state.groupBy("s", "t").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("k"))
    joined = pairs.join(_packed(source, "s"), "s").join(_packed(target, "t"), "t")
    kind = to_arrow_schema(state.sparkSession.createDataFrame([], schema).schema)
    parts = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return joined.repartition(4 * parts, "s", "t").mapInArrow(of_pair, schema)


def _split(state: DataFrame, source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The keys whose segments a task holds, and the others, if there are any."""
    large = [p.groupBy(F.col("seg").alias(k)).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > HELD).select(k) for k, p in (("s", source), ("t", target))]
    if all(x.isEmpty() for x in large):
        return state, None
    small = state.join(large[0], "s", "left_anti").join(large[1], "t", "left_anti").select(state.columns)
    return small, state.join(small.select("vote"), "vote", "left_anti").select(state.columns)


def icp_of_pairs(state: DataFrame, source: DataFrame, target: DataFrame, steps: int = STEPS) -> DataFrame:
    """What `icp` gives: a pair of segments of up to HELD points with its starts takes all steps in a task, pairs with larger ones take `icp`. source, target: seg, id, v, n."""

    def run(rows: list[dict], sv: np.ndarray, sn: np.ndarray, tv: np.ndarray, tn: np.ndarray) -> list[dict]:
        p, q = Boxes(sv), Boxes(tv)
        px, pn, found = sv[p.order], sn[p.order], []
        for row in rows:
            a, first, hit = np.asarray(row["a"], float).reshape(1, 3, 4), np.asarray(row["first"], float).reshape(1, 3, 4), None
            for _ in range(steps):
                x = sum(px[:, j][:, None] * a[0, :, j][None] for j in AXES) + a[0, :, 3]
                turned = pn @ rotations(a[:, :, :3])[0].T
                hit, d = q.nearest(p, x, hit)
                keep = (d < np.partition(d, len(d) // 2)[len(d) // 2] * REJECT) & ((turned * tn[hit]).sum(axis=1) > 0)
                x, y = x[keep], tv[hit[keep]]
                moments = (x.sum(axis=0), y.sum(axis=0), x.T @ x, x.T @ y)
                a, done = _fitted(a, first, np.array([float(keep.sum())]), *[m.reshape(1, -1) for m in moments])
                if done[0]:
                    break
            found.append({"a": a[0].ravel().tolist(), "r": rotations(a[:, :, :3]).ravel().tolist()})
        return found

    small, large = _split(state, source, target)
    types = state.schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ")
    out = _of_pairs(small, source, target, run, types)
    return out if large is None else out.unionByName(icp(stored(large), source, tree_of(target), steps))


def distances_of_pairs(state: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """What `matched_distances` gives, a pair of segments of up to HELD points in a task. state: vote, s, t, a, r."""

    def run(rows: list[dict], sv: np.ndarray, sn: np.ndarray, tv: np.ndarray, tn: np.ndarray) -> list[dict]:
        p, q = Boxes(sv), Boxes(tv)
        px, pn, found = sv[p.order], sn[p.order], []
        for row in rows:
            a, r = np.asarray(row["a"], float).reshape(3, 4), np.asarray(row["r"], float).reshape(3, 3)
            hit, d = q.nearest(p, sum(px[:, j][:, None] * a[:, j][None] for j in AXES) + a[:, 3])
            cosine = (sum(pn[:, j][:, None] * r[:, j][None] for j in AXES) * tn[hit]).sum(axis=1)
            found.append({"position": float(d.mean()), "normal": 1 - float(cosine.mean()), "n": len(d)})
        return found

    small, large = _split(state.select("vote", "s", "t", "a", "r"), source, target)
    kinds = dict(state.dtypes)
    out = _of_pairs(small, source, target, run, f"vote {kinds['vote']}, s {kinds['s']}, t {kinds['t']}, position double, normal double, n long").drop("s", "t")
    return out if large is None else out.unionByName(matched_distances(stored(large), source, tree_of(target)))


def matched_distances(state: DataFrame, points: DataFrame, tree: rtree.Tree) -> DataFrame:
    """(vote, position, normal, n): mean distance of a key's moved points to the nearest target points, and one less the mean cosine of their normals."""
    return matches(state, points, tree).groupBy("vote").agg(F.avg("d").alias("position"), (1 - F.avg("cosine")).alias("normal"), F.count(F.lit(1)).alias("n"))


def votes(source: DataFrame, target: DataFrame, radius: float) -> DataFrame:
    """(vote, s, t, start, a, r): alignments of all similar pairs of segments from all starts, on all points of both. source, target: seg, id, v, n; radius: of the points' sampling.

    Segments of fewer than LEAST points give none. Repeated rows count each time; an empty table gives no rows."""
    some, other = stored(enough(source)), stored(enough(target))
    pairs = similar_pairs(frames(some, radius), frames(other, radius))
    return icp_of_pairs(begun(pairs), some, other).drop("first")


#: Names of before, which tests call.
sample, icp_of_samples = enough, icp_of_pairs
