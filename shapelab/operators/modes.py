"""Modes of weighted transforms: mean shift with a bandwidth for each place, and the pruning of modes that are alike.

Climbs among few points take all their steps in one task, with a group's points beside them. In larger groups a
climb's step is one neighbour search (`rtree`) for all climbs that still move, within their groups; places that several
climbs have reached are looked up once. Nothing but counts comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelab.operators import rtree
from shapelab.operators.graph import keep_first
from shapelab.session import stored

#: Weight (as a share of a group's) within a bandwidth, neighbours at most, part of a bandwidth at which a climb stands, range of a mode in bandwidths, points up to which each is a mode.
ENOUGH, MOST, SETTLE, MERGE, FEW = 0.01, 100, 1e-4, 1.0, 20
#: Steps of a climb at most; one that doesn't stand by then has no mode.
STEPS = 10_000
#: Points of a group up to which its climbs take all steps in a task, climbs of a task; modes of a group up to which a task scans them, groups at once.
HELD, CLIMBS, SCANNED, GROUPS = 4096, 256, 256, 512
#: Bounds of two modes that are one: in radii of the sampling, degrees, and as a ratio of scales; a valid mode's scales.
NEAR_T, NEAR_R, NEAR_S, SCALES = 2.0, 5.0, 1.1, (0.2, 5.0)


def _distance(a: Column, b: Column, dims: int) -> Column:
    return F.sqrt(sum(((a[d] - b[d]) * (a[d] - b[d]) for d in range(dims)), F.lit(0.0)))


def step(tree: rtree.Tree, places: DataFrame, fixed: float | None = None) -> DataFrame:
    """(place, next, bandwidth): the weighted mean of the points within each place's bandwidth.

    places: place (a struct of key and v). With no fixed bandwidth it is the distance at which the weights of the nearest
    points, MOST at most, exceed ENOUGH; points at that distance after it don't count."""
    q = places.select(F.col("place").alias("query"), F.col("place.key").alias("key"), F.col("place.v").alias("at"))
    near = rtree.search(tree, q, MOST) if fixed is None else rtree.search(tree, q, radius=F.lit(fixed))
    kept = F.array_sort(F.collect_list(F.struct("d", "id", "w", "v")))
    rows = near.groupBy("query").agg(kept.alias("p"))
    if fixed is None:
        count = F.aggregate("p", F.struct(F.lit(0.0).alias("w"), F.lit(0).alias("n")), lambda s, p: F.when(s["w"] > ENOUGH, s).otherwise(F.struct((s["w"] + p["w"]).alias("w"), (s["n"] + 1).alias("n"))))
        rows = rows.withColumn("p", F.slice("p", 1, F.greatest(count["n"], F.lit(1)))).withColumn("bandwidth", F.element_at("p", -1)["d"])
    else:
        rows = rows.withColumn("bandwidth", F.lit(fixed))
    total = F.aggregate("p", F.lit(0.0), lambda s, p: s + p["w"])
    mean = lambda d: F.aggregate("p", F.lit(0.0), lambda s, p: s + p["w"] * p["v"][d]) / F.col("total")
    means = [mean(d) for d in range(tree.dims)]
    rows = rows.withColumn("total", total)
    return rows.select(F.col("query").alias("place"), F.when(F.col("total") > 0, F.array(*means)).otherwise(F.col("query.v")).alias("next"), "bandwidth")


def climb(tree: rtree.Tree, starts: DataFrame, fixed: float | None = None, steps: int = STEPS) -> DataFrame:
    """(id, key, v, bandwidth): where each climb stands, and the bandwidth there. A climb without points within its bandwidth stays; one that doesn't stand after `steps` is left out.

    starts: id, key, v."""
    open_, done = starts.select("id", F.struct("key", "v").alias("place")), None
    for _ in range(steps):
        moves = step(tree, open_.select("place").distinct(), fixed)
        after = open_.join(moves, "place", "left").withColumn("next", F.coalesce("next", "place.v")).withColumn("bandwidth", F.coalesce("bandwidth", F.lit(fixed or 0.0)))
        stands = _distance(F.col("place.v"), F.col("next"), tree.dims) <= F.col("bandwidth") * SETTLE
        after = stored(after.select("id", F.col("place.key").alias("key"), F.col("next").alias("v"), "bandwidth", stands.alias("stands")))
        still = after.where("stands").drop("stands")
        done = still if done is None else done.unionByName(still)
        open_ = after.where("not stands").select("id", F.struct("key", "v").alias("place"))
        if open_.isEmpty():
            break
    return stored(done)


def climb_held(points: DataFrame, starts: DataFrame, dims: int, fixed: float | None = None, steps: int = STEPS) -> DataFrame:
    """What `climb` gives, for groups of at most HELD points, of which a task gets all with CLIMBS of the group's climbs or so.

    points: key, id, v, w; starts: id, key, v."""
    held = points.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", "v", "w"))).alias("p"))
    held = held.select("key", F.flatten("p.v").alias("p_v"), F.col("p.w").alias("p_w"))
    size = starts.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CLIMBS).alias("_parts"))
    dealt = starts.join(size, "key").withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts"))).select("key", "_part", F.struct("id", "v").alias("start"))
    dealt = dealt.groupBy("key", "_part").agg(F.collect_list("start").alias("starts"))
    kind = {f.name: f.dataType.simpleString() for f in starts.schema}

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in g.itertuples():
            v, w = np.asarray(r.p_v, float).reshape(-1, dims), np.asarray(r.p_w, float)
            at = np.array([s["v"] for s in r.starts], float).reshape(-1, dims)
            open_ = np.arange(len(at))
            for _ in range(steps):
                new, band = _stepped(at[open_], v, w, fixed)
                stands = np.sqrt(((at[open_] - new) ** 2).sum(axis=1)) <= band * SETTLE
                at[open_] = new
                out += [(r.starts[i]["id"], r.key, at[i].tolist(), b) for i, b in zip(open_[stands], band[stands], strict=True)]
                open_ = open_[~stands]
                if not len(open_):
                    break
        return pd.DataFrame(out, columns=["id", "key", "v", "bandwidth"])

    return stored(dealt.join(held, "key").groupBy("key", "_part").applyInPandas(run, f"id {kind['id']}, key {kind['key']}, v array<double>, bandwidth double"))


def _stepped(at: np.ndarray, v: np.ndarray, w: np.ndarray, fixed: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(next, bandwidth) of places among points in order of their ids: `step` in a task."""
    square = np.zeros((len(at), len(v)))
    for d in range(v.shape[1]):
        gap = v[:, d][None] - at[:, d][:, None]
        square += gap * gap
    far = np.sqrt(square, out=square)
    if fixed is not None:
        take, band = np.where(far * far <= fixed * fixed * (1 + rtree.SLACK), w[None], 0.0), np.full(len(at), fixed)
        total, sums = take.sum(axis=1), take @ v
    else:
        near = np.argsort(far, axis=1, kind="stable")[:, :MOST]
        weights = w[near]
        # a point counts unless those before it weigh enough, added up in their order
        before = np.concatenate([np.zeros((len(at), 1)), np.cumsum(weights, axis=1)[:, :-1]], axis=1)
        n = np.maximum((np.maximum.accumulate(before, axis=1) <= ENOUGH).sum(axis=1), 1)
        weights = np.where(np.arange(weights.shape[1])[None] < n[:, None], weights, 0.0)
        band = np.take_along_axis(far, np.take_along_axis(near, n[:, None] - 1, 1), 1)[:, 0]
        total, sums = weights.sum(axis=1), np.einsum("nk,nkd->nd", weights, v[near])
    some = total > 0
    return np.where(some[:, None], sums / np.where(some, total, 1)[:, None], at), band


def pushed(at: DataFrame, dims: int) -> DataFrame:
    """(id, key, v): places moved by up to twice a bandwidth's share in each dimension, by a hash of the id and the dimension in place of a random number."""
    share = F.col("bandwidth") * 2 / (dims**0.5)
    unit = lambda d: F.pmod(F.crc32(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(d))).cast("binary")), F.lit(1 << 20)) / float((1 << 20) - 1) * 2 - 1
    return at.select("id", "key", F.array(*[F.col("v")[d] + share * unit(d) for d in range(dims)]).alias("v"))


def mean_shift(points: DataFrame, dims: int, fixed: float | None = None, steps: int = STEPS) -> DataFrame:
    """(key, id, mode, rank): the point that is the mode of each point, and that mode's place by weight in its group; null for points whose climb has none.

    Every point climbs (`climb`); what it reaches is pushed away and has to come back within half of a mode's range, or it is
    a saddle and has no mode; it then snaps to the heaviest point within its bandwidth (in order of distance the first that has
    ENOUGH by itself), to the nearest if there is none. Modes are taken in order of weight, and one in the range of one taken
    before, or that has it in its own range, goes, with its points. A group of FEW points or fewer has each of its points
    as a mode. points: key, id (no two rows share both), v (`dims` doubles), w (sums to one in a group)."""
    points = stored(points.select("key", F.col("id").cast("long"), "v", F.col("w").cast("double")))
    size = points.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    sized = points.join(size, "key")
    few = sized.where(F.col("size") <= FEW).select("key", "id", F.col("id").alias("mode"), "w")
    many = stored(sized.where(F.col("size") > FEW).select("key", "id", "v", "w"))
    tree = rtree.build(many, dims)
    name = F.struct("key", F.col("id").alias("n")).alias("id")
    large = size.where(F.col("size") > HELD).select("key")
    any_large = not large.isEmpty()
    small = many.join(large, "key", "left_anti") if any_large else many

    def climbed(starts: DataFrame) -> DataFrame:
        held = climb_held(small, starts.join(large, "key", "left_anti") if any_large else starts, dims, fixed, steps)
        return held.unionByName(climb(tree, starts.join(large, "key", "left_semi"), fixed, steps)) if any_large else held

    top = climbed(many.select(name, "key", "v"))
    back = climbed(pushed(top, dims)).select("id", F.col("v").alias("again"))
    kept = top.join(back, "id").where(_distance(F.col("v"), F.col("again"), dims) <= F.col("bandwidth") * MERGE * 0.5)
    kept = stored(kept.select("id", "key", "v", "bandwidth"))
    q = kept.select(F.struct("key", "v", "bandwidth").alias("query")).distinct().select("query", "query.key", F.col("query.v").alias("at"), F.col("query.bandwidth").alias("b"))
    near = stored(rtree.search(tree, q, radius=F.col("b") if fixed is None else F.lit(fixed)).select("query", "id", "d", "w"))
    heavy = F.min(F.when(F.col("w") > ENOUGH, F.struct("d", "id")))
    snapped = near.groupBy("query").agg(heavy.alias("first"), F.min(F.struct((-F.col("w")).alias("m"), "d", "id")).alias("best"))
    # up to the first point of enough weight the heaviest is that one, as the walk ends there
    snap = snapped.select("query", F.coalesce("first.id", "best.id").alias("mode"))
    lost = rtree.search(tree, q.join(snap, "query", "left_anti").select("query", "key", "at"), 1).select("query", F.col("id").alias("mode"))
    snap = snap.unionByName(lost)
    own = kept.withColumn("query", F.struct("key", "v", "bandwidth")).join(snap, "query").select("key", F.col("id.n").alias("id"), "mode", "bandwidth")
    own = stored(own)
    # a mode's range is the bandwidth of its own climb; one without is none
    ranges = own.select("key", F.col("id").alias("mode"), (F.col("bandwidth") * MERGE).alias("range"))
    heads = own.select("key", "mode").distinct().join(ranges, ["key", "mode"])
    heads = stored(heads.join(many.select("key", F.col("id").alias("mode"), "v", "w"), ["key", "mode"]))
    node = F.struct("key", (-F.col("w")).alias("m"), "mode")
    mode_tree = rtree.build(heads.select("key", F.col("mode").alias("id"), "v", F.struct("range", "w").alias("w")), dims)
    seen = rtree.search(mode_tree, heads.select(F.struct("key", (-F.col("w")).alias("m"), "mode", "range").alias("query"), "key", F.col("v").alias("at"), "range"), radius=F.col("range"))
    seen = seen.where("d < query.range")
    pairs = seen.select(F.col("query").dropFields("range").alias("a"), F.struct(F.col("query.key").alias("key"), (-F.col("w.w")).alias("m"), F.col("id").alias("mode")).alias("b")).where("a <> b")
    taken = keep_first(heads.select(node.alias("node")), pairs).select("node.key", "node.mode")
    modes = few.select("key", "mode", "w").unionByName(taken.join(many.select("key", F.col("id").alias("mode"), "w"), ["key", "mode"]))
    modes = ranked(stored(modes), "key", [F.desc("w"), F.col("mode")])
    mine = few.select("key", "id", "mode").unionByName(own.select("key", "id", "mode"))
    return points.select("key", "id").join(mine.join(modes.select("key", "mode", "rank"), ["key", "mode"]), ["key", "id"], "left").select("key", "id", "mode", "rank")


def ranked(modes: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Adds `rank` from 0 on. Modes lie apart, so that a group has few."""
    from pyspark.sql import Window

    return modes.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def pruned(modes: DataFrame, radius: float) -> DataFrame:
    """(key, id, rank): modes that a scan keeps, from the heaviest to the lightest, if it drops those with odd scales and those like one kept before.

    The mode with `pinned` comes first whatever its weight, and its scales aren't looked at. Two are alike if their shifts are nearer than NEAR_T
    radii, their turns than NEAR_R degrees, and their scales than NEAR_S times. modes: key, id, pinned, weight, t (3), q (x, y, z, w), s (3).
    A group of SCANNED modes or fewer is scanned in a task, with many others. In larger ones near shifts are found by a search in the group, and the
    scan runs in rounds over all groups at once (`keep_first`), ordered by (key, not pinned, -weight, id)."""
    scales = F.lit(True)
    for d in range(3):
        scales = scales & F.abs(F.col("s")[d]).between(*SCALES)
    node = F.struct("key", (~F.col("pinned")).alias("late"), (-F.col("weight")).alias("m"), "id")
    rows = stored(modes.where(F.col("pinned") | scales).withColumn("node", node))
    large = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SCANNED).select("key"))
    if large.isEmpty():
        return _scanned(rows, radius)
    return _scanned(rows.join(large, "key", "left_anti"), radius).unionByName(_searched(rows.join(large, "key", "left_semi"), radius))


def _scanned(rows: DataFrame, radius: float) -> DataFrame:
    """`pruned` for groups of few modes: tasks scan groups of a like size together. A group is read whole, SCANNED rows at most."""
    key = dict(rows.dtypes)["key"]
    columns = [F.col("node.late").alias("late"), F.col("node.m").alias("m"), *[F.col(c)[d].cast("double").alias(f"{c}{d}") for c, n in (("t", 3), ("q", 4), ("s", 3)) for d in range(n)]]
    flat = rows.select("key", "id", *columns).repartition("key").sortWithinPartitions("key", "late", "m", "id").drop("late", "m")
    kind = f"key {key}, id {dict(rows.dtypes)['id']}, rank int"
    angle = np.radians(NEAR_R)

    def kept(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which modes of groups of n modes stay; x: group, mode, (t, q, s)."""
        keep = np.zeros(x.shape[:2], bool)
        for j in range(x.shape[1]):
            a, b = x[:, :j], x[:, j, None]
            gap = sum((b[..., d] - a[..., d]) ** 2 for d in range(3))
            near = keep[:, :j] & (np.sqrt(gap) < NEAR_T * radius)
            near &= 2 * np.arccos(np.fmin(np.abs(sum(a[..., d] * b[..., d] for d in range(3, 7))), 1.0)) < angle
            for d in range(7, 10):
                ratio = b[..., d] / a[..., d]
                near &= (ratio < NEAR_S) & (ratio > 1 / NEAR_S)
            keep[:, j] = (j < n) & ~near.any(axis=1)
        return keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_groups(batches):
            x = np.stack([rows.column(c).to_numpy() for c in range(2, 12)], axis=1)
            n = np.diff(np.append(starts, len(x)))
            order, keep, rank = np.argsort(n, kind="stable"), np.zeros(len(x), bool), np.zeros(len(x), np.int32)
            for i in range(0, len(order), GROUPS):
                g = order[i : i + GROUPS]
                at = np.arange(n[g].max())
                own = starts[g][:, None] + np.minimum(at[None], n[g][:, None] - 1)
                with np.errstate(all="ignore"):
                    stay = kept(x[own], n[g])
                some = at[None] < n[g][:, None]
                keep[own[some]], rank[own[some]] = stay[some], (np.cumsum(stay, axis=1) - 1)[some]
            taken = rows.select(["key", "id"]).append_column("rank", pa.array(rank)).filter(pa.array(keep)).combine_chunks()
            yield from taken.to_batches()

    return flat.mapInArrow(run, kind)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, where groups begin) of rows sorted by key, a batch at a time; a batch's last group waits for the next one."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not rows.num_rows:
            continue
        starts = _group_starts(rows)
        held = rows.slice(int(starts[-1]))
        if len(starts) > 1:
            yield rows.slice(0, int(starts[-1])), starts[:-1]
    if held is not None and held.num_rows:
        yield held, _group_starts(held)


def _group_starts(rows: pa.Table) -> np.ndarray:
    code = rows.column("key").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))


def _searched(rows: DataFrame, radius: float) -> DataFrame:
    """`pruned` for groups of any size."""
    tree = rtree.build(rows.select("key", "id", F.col("t").alias("v"), F.struct("node", "q", "s").alias("w")), 3)
    q = rows.select(F.struct("node", "q", "s").alias("query"), "key", F.col("t").alias("at"))
    near = rtree.search(tree, q, radius=F.lit(NEAR_T * radius)).where((F.col("d") < NEAR_T * radius) & (F.col("query.node") < F.col("w.node")))
    dot = F.abs(sum((F.col("query.q")[d] * F.col("w.q")[d] for d in range(4)), F.lit(0.0)))
    angle = 2 * F.acos(F.least(dot, F.lit(1.0)))
    near = near.where(angle < F.radians(F.lit(NEAR_R)))
    for d in range(3):
        ratio = F.col("w.s")[d] / F.col("query.s")[d]
        near = near.where((ratio < NEAR_S) & (ratio > 1 / NEAR_S))
    kept = keep_first(rows.select("node"), near.select(F.col("query.node").alias("a"), F.col("w.node").alias("b")))
    return ranked(kept.select("node.*"), "key", [F.col("late"), F.col("m"), F.col("id")]).select("key", "id", "rank")
