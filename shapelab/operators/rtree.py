"""Exact neighbour joins in a few dimensions, whatever the density and within any number of groups.

Points are sorted by group and Morton code and packed, FAN at a time, into leaves; the leaves' boxes are packed into
nodes, and so on up to one root for each group. A leaf has FAN points at most, also where half of all points lie in one
place, and a large group is spread over the tasks of the sort. A search for k points goes down twice: first to the one leaf whose box is
nearest, whose k-th distance bounds what is to be found, then to all leaves whose boxes lie within that bound. Queries meet
nodes in blocks: those of a node are gathered, dealt over PARTS tasks, and held against its children at once (numpy).
Boxes of a level that has few are sent to the tasks; deeper ones are met by equi-joins. No pair of points leaves
a visited leaf but its k best, or those within the radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapelab.operators.skew import hot_keys
from shapelab.session import cut

#: Points of a leaf, and children of a node, at most.
FAN = 64
#: Boxes of a level that are sent to every task, at most.
SENT = 4096
#: Tasks over which the queries of one node are dealt; distances that are held at once.
PARTS, HELD = 16, 1 << 21
#: Rows that a task gives away at once; leaves that pass by a tile at once.
MADE, AT_ONCE = 1 << 16, 256
#: A box may be further than the bound by this share and still be looked at: distances are rounded.
SLACK = 1e-9


#: Nodes, numbers of points, and the two ends of boxes.
Boxes = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Surroundings(Protocol):
    """What is made of a tile: takes ids and places that pass by, then gives its rows."""

    def add(self, ids: np.ndarray, v: np.ndarray) -> None: ...

    def made(self) -> pa.RecordBatch: ...


@dataclass
class Tree:
    """levels[0]: the leaves (key, node, n, kids: id, v, w); the others: nodes (kids: node, n, lo, hi). levels[-1]: one root for each key.

    sent: the lowest level of few boxes, and by key its (node, n, lo, hi); None if even the roots are many."""

    levels: list[DataFrame]
    dims: int
    counts: list[int]
    sent: tuple[int, dict[str, Boxes]] | None


def morton(dims: int, lo: list[float], hi: list[float]) -> Column:
    """Interleaved bits of the coordinates of v, scaled to the box."""
    bits = 62 // dims
    cells = []
    for d in range(dims):
        span = hi[d] - lo[d]
        at = f"(v[{d}] - {lo[d]!r}D) / {span!r}D" if 0 < span < float("inf") else "0D"
        cells.append(f"least(cast(floor({at} * {1 << bits}D) as bigint), {(1 << bits) - 1}L)")
    # as one text, since a column of so many parts takes seconds to be put together part by part
    return F.expr(" | ".join(f"shiftleft(shiftright({cells[d]}, {b}) & 1L, {b * dims + d})" for b in range(bits) for d in range(dims)))


def _packed(sorted_rows: DataFrame, kid: str, box: str, key_type: str) -> DataFrame:
    """Sorted rows (key, kid, lo, hi, n) packed: (key, node, n, lo, hi, kids). A node's number says in which task it was made, and where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, held = TaskContext.get().partitionId() << 40, 0, None
        for batch in chain(batches, [None]):
            rows = pa.table([], []) if batch is None else pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows]) if batch is not None else held
            if not rows.num_rows:
                continue
            keys = rows.column("key").combine_chunks()
            keys = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False) if keys.null_count == 0 else np.array([str(k) for k in keys.to_pylist()])
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            starts = np.concatenate([np.arange(a, b, FAN) for a, b in zip(new, [*new[1:], len(keys)], strict=True)])
            keep = len(keys) if batch is None else int(starts[-1])  # the last node may go on in the next batch
            starts = starts[starts < keep]
            held = rows.slice(keep).combine_chunks() if batch is not None else None
            if not len(starts):
                continue
            rows = rows.slice(0, keep).combine_chunks()
            n, lo, hi = (rows.column(c).combine_chunks() for c in ("n", "lo", "hi"))
            lo, hi = (x.flatten().to_numpy(zero_copy_only=False).reshape(keep, -1) for x in (lo, hi))
            kids = pa.ListArray.from_arrays(pa.array(np.append(starts, keep).astype(np.int32)), rows.column("kid").combine_chunks())
            cols = [rows.column("key").combine_chunks().take(pa.array(starts)), pa.array(base + made + np.arange(len(starts))), pa.array(np.add.reduceat(n.to_numpy(zero_copy_only=False), starts))]
            boxes = [pa.array(list(f.reduceat(x, starts, axis=0)), pa.list_(pa.float64())) for f, x in ((np.minimum, lo), (np.maximum, hi))]
            made += len(starts)
            yield pa.RecordBatch.from_arrays([*cols, *boxes, kids], ["key", "node", "n", "lo", "hi", "kids"])

    return sorted_rows.select("key", "n", "lo", "hi", F.col(kid).alias("kid")).mapInArrow(run, f"key {key_type}, node long, n long, lo array<double>, hi array<double>, kids array<{box}>")


def build(points: DataFrame, dims: int) -> Tree:
    """points: key (not null), id (long), v (array of `dims` doubles), w (anything that goes with a point)."""
    ends = points.agg(*[f(F.col("v")[d]) for d in range(dims) for f in (F.min, F.max)]).first()
    lo, hi = [float(x or 0) for x in ends[::2]], [float(x or 0) for x in ends[1::2]]
    types = {f.name: f.dataType.simpleString() for f in points.schema}
    rows = points.select("key", F.struct(F.col("id").cast("long"), "v", "w").alias("point"), F.col("v").alias("lo"), F.col("v").alias("hi"), F.lit(1).cast("long").alias("n"), morton(dims, lo, hi).alias("code"), F.col("id").alias("id"))
    rows = rows.repartitionByRange("key", "code", "id").sortWithinPartitions("key", "code", "id")
    level = cut(_packed(rows, "point", f"struct<id: bigint, v: array<double>, w: {types['w']}>", types["key"]))
    levels, counts = [level], []
    while True:
        nodes, most = level.groupBy("key").agg(F.count(F.lit(1)).alias("m")).agg(F.sum("m"), F.max("m")).first()
        counts.append(nodes or 0)
        if (most or 0) <= 1:
            break
        up = level.select("key", F.struct("node", "n", "lo", "hi").alias("child"), "lo", "hi", "n", F.col("node").alias("at"))
        # few nodes are packed by one task; keys of few nodes aren't cut, since every task of a sort can leave one node of a key unfilled
        up = up.coalesce(1) if nodes <= SENT else up.repartitionByRange("key") if most <= FAN else up.repartitionByRange("key", "at")
        level = cut(_packed(up.sortWithinPartitions("key", "at"), "child", "struct<node: bigint, n: bigint, lo: array<double>, hi: array<double>>", types["key"]))
        levels.append(level)
    return Tree(levels, dims, counts, next(((i, _boxes(x, dims)) for i, (x, n) in enumerate(zip(levels, counts, strict=True)) if n <= SENT), None))


def _boxes(level: DataFrame, dims: int) -> dict[str, Boxes]:
    """The boxes of a level of few nodes by key."""
    by: dict[str, list] = {}
    for r in level.select(F.col("key").cast("string").alias("key"), "node", "n", "lo", "hi").collect():
        by.setdefault(r[0], []).append(r[1:])
    return {k: (np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), *(np.array([r[i] for r in rows], float).reshape(-1, dims) for i in (2, 3))) for k, rows in by.items()}


def _chosen(at: np.ndarray, bound: np.ndarray, boxes: Boxes, k: int | None, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, box, bound) of what is to be visited: of each query the one nearest box (`first`), or all within the bound, which is a square.

    If the boxes that lie within a distance as a whole hold k points, that distance is a bound too."""
    _, n, lo, hi = boxes
    found = []
    for i in range(0, len(at), step := max(1, HELD // max(1, len(lo)))):
        a, b = at[i : i + step], bound[i : i + step]
        least, most = np.zeros((len(a), len(lo))), np.zeros((len(a), len(lo)))
        for d in range(at.shape[1]):
            under, over = lo[None, :, d] - a[:, d, None], a[:, d, None] - hi[None, :, d]
            least += np.maximum(np.maximum(under, over), 0.0) ** 2
            most += np.maximum(-under, -over) ** 2
        if k is not None and not first:
            order = np.argsort(most, axis=1) if k > 1 else most.argmin(axis=1)[:, None]
            enough = np.cumsum(n[order], axis=1) >= k
            at_k = np.take_along_axis(np.take_along_axis(most, order, 1), enough.argmax(axis=1)[:, None], 1)[:, 0]
            b = np.minimum(b, np.where(enough.any(axis=1), at_k, np.inf))
        near = least <= (b * (1 + SLACK))[:, None]
        if first:  # of boxes that a query lies in, the smallest
            box = np.where(least <= least.min(axis=1)[:, None], most, np.inf).argmin(axis=1)
            q = np.flatnonzero(near[np.arange(len(a)), box])
            box = box[q]
        else:
            q, box = np.nonzero(near)
        found.append((q + i, box, b[q]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _numbers(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), dims)


def _children(kids: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each row's children begin, and all of them."""
    at = kids.offsets.to_numpy()
    return at - at[0], kids.flatten()


def _opened(q: pa.Array, i: np.ndarray, bound: np.ndarray, keys: list[str], nodes: np.ndarray) -> pa.RecordBatch:
    """The queries i of (query, _k, at), with their bound, and the node that each one goes to."""
    taken = q.take(pa.array(i))
    names = ["query", "_k", "at"]
    state = pa.StructArray.from_arrays([*[pc.struct_field(taken, n) for n in names], pa.array(bound)], [*names, "bound"])
    return pa.RecordBatch.from_arrays([state, pa.array([f"{k}/{n}" for k, n in zip(keys, nodes.tolist(), strict=True)], pa.string())], ["q", "on"])


def _begun(rows: DataFrame, kind: T.StructType, tree: Tree, k: int | None, first: bool) -> DataFrame:
    """(q, on): rows (q) with the nodes to visit on the level that is sent; if none is, with their roots."""
    out = T.StructType([T.StructField("q", kind), T.StructField("on", T.StringType())])
    if tree.sent is None:
        root = tree.levels[-1].select(F.col("key").cast("string").alias("_k"), F.concat_ws("/", F.col("key").cast("string"), F.col("node").cast("string")).alias("on"))
        return rows.select("q", F.col("q._k").alias("_k")).join(root, "_k").select("q", "on")
    boxes, dims = tree.sent[1], tree.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(0)
            coded = pc.struct_field(q, "_k").dictionary_encode()
            code, at, bound = coded.indices.to_numpy(zero_copy_only=False), _numbers(pc.struct_field(q, "at"), dims), pc.struct_field(q, "bound").to_numpy(zero_copy_only=False)
            for c, key in enumerate(coded.dictionary.to_pylist()):
                if key in boxes:
                    mine = np.flatnonzero(code == c)
                    i, box, b = _chosen(at[mine], bound[mine], boxes[key], k, first)
                    for s in range(0, len(i), MADE):
                        part = slice(s, s + MADE)
                        yield _opened(q, mine[i[part]], b[part], [key] * len(i[part]), boxes[key][0][box[part]])

    return rows.select("q").mapInArrow(run, out)


def _gathered(open_: DataFrame, tree: Tree, level: int) -> DataFrame:
    """(qs, kids): the queries that visit a node with its children. Each of few nodes is dealt over PARTS rows, of many only those that very many visit."""
    on = F.concat_ws("/", F.col("key").cast("string"), F.col("node").cast("string"))
    parts = F.lit(PARTS)
    if tree.counts[level] > SENT:
        open_ = cut(open_)
        hot = hot_keys(open_, "on")
        parts = F.lit(1) if hot is None else F.coalesce("_parts", F.lit(1))
        open_ = open_ if hot is None else open_.join(F.broadcast(hot), "on", "left")
    blocks = open_.groupBy("on", F.pmod(F.xxhash64("q"), parts).alias("_part")).agg(F.collect_list("q").alias("qs"))
    return blocks.join(tree.levels[level].select(on.alias("on"), "kids"), "on").select("qs", "kids")


def _down(open_: DataFrame, kind: T.StructType, tree: Tree, level: int, k: int | None, first: bool) -> DataFrame:
    """(q, on) on the level below."""
    dims = tree.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (qo, q), (ko, kids) = _children(batch.column(0)), _children(batch.column(1))
            at, bound, keys = _numbers(pc.struct_field(q, "at"), dims), pc.struct_field(q, "bound").to_numpy(zero_copy_only=False), pc.struct_field(q, "_k")
            node, n = (pc.struct_field(kids, c).to_numpy(zero_copy_only=False) for c in ("node", "n"))
            lo, hi = (_numbers(pc.struct_field(kids, c), dims) for c in ("lo", "hi"))
            some, n_some = [], 0
            for r in range(batch.num_rows):
                a, s = slice(qo[r], qo[r + 1]), slice(ko[r], ko[r + 1])
                i, box, b = _chosen(at[a], bound[a], (node[s], n[s], lo[s], hi[s]), k, first)
                some.append((qo[r] + i, b, node[s][box]))
                n_some += len(i)
                if n_some >= MADE or (n_some and r == batch.num_rows - 1):
                    i, b, to = (np.concatenate(c) for c in zip(*some, strict=True))
                    yield _opened(q, i, b, keys.take(pa.array(i)).to_pylist(), to)
                    some, n_some = [], 0

    return _gathered(open_, tree, level).mapInArrow(run, T.StructType([T.StructField("q", kind), T.StructField("on", T.StringType())]))


def _pairs(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, points, squares of distances) of a batch of leaves, a block at a time; points in order of their ids."""
    (qo, q), (ko, kids) = _children(batch.column(0)), _children(batch.column(1))
    at, v, ids = _numbers(pc.struct_field(q, "at"), dims), _numbers(pc.struct_field(kids, "v"), dims), pc.struct_field(kids, "id").to_numpy(zero_copy_only=False)
    for r in range(batch.num_rows):
        p = ko[r] + np.argsort(ids[ko[r] : ko[r + 1]], kind="stable")
        for i in range(qo[r], qo[r + 1], step := max(1, HELD // max(1, len(p)))):
            a = np.arange(i, min(i + step, qo[r + 1]))
            square = np.zeros((len(a), len(p)))
            for d in range(dims):
                square += (v[p, d][None] - at[a, d][:, None]) ** 2
            yield a, p, square


def _bounded(open_: DataFrame, kind: T.StructType, tree: Tree, k: int) -> DataFrame:
    """(q): queries with the k-th distance in their leaf as a bound, if it holds k points."""
    dims = tree.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(0).flatten()
            bound = pc.struct_field(q, "bound").to_numpy(zero_copy_only=False).copy()
            for a, p, square in _pairs(batch, dims):
                if len(p) >= k:
                    bound[a] = np.minimum(bound[a], np.partition(square, k - 1, axis=1)[:, k - 1])
            names = ["query", "_k", "at"]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([*[pc.struct_field(q, n) for n in names], pa.array(bound)], [*names, "bound"])], ["q"])

    return _gathered(open_, tree, 0).mapInArrow(run, T.StructType([T.StructField("q", kind)]))


def _found(open_: DataFrame, kind: T.StructType, tree: Tree, k: int | None, bare: bool) -> DataFrame:
    """(query, p): the k nearest points (d, id, w, v) of each query in each leaf that it visits, or all, within its bound; without w and v if `bare`."""
    dims = tree.dims
    point = tree.levels[0].schema["kids"].dataType.elementType
    names = ["id"] if bare else ["id", "w", "v"]
    p_type = T.StructType([T.StructField("d", T.DoubleType()), *[T.StructField(c, point[c].dataType) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, kids = pc.struct_field(batch.column(0).flatten(), "query"), batch.column(1).flatten()
            bound = pc.struct_field(batch.column(0).flatten(), "bound").to_numpy(zero_copy_only=False) * (1 + SLACK)
            some, n = [], 0  # of several leaves, as one may find little

            def made() -> pa.RecordBatch:
                x, y, far = (np.concatenate(c) for c in zip(*some, strict=True))  # noqa: B023
                taken = kids.take(pa.array(y))  # noqa: B023
                found = pa.StructArray.from_arrays([pa.array(far), *[pc.struct_field(taken, c) for c in names]], ["d", *names])
                return pa.RecordBatch.from_arrays([query.take(pa.array(x)), found], ["query", "p"])  # noqa: B023

            for a, p, square in _pairs(batch, dims):
                far = np.sqrt(square)
                inside = far * far <= bound[a][:, None]
                if k == 1:
                    best = np.where(inside, far, np.inf).argmin(axis=1)
                    i = np.flatnonzero(inside.any(axis=1))
                    j = best[i]
                elif k is not None and len(p) > k:
                    # points are in order of ids, which a stable sort keeps among equal distances
                    order = np.argsort(np.where(inside, far, np.inf), axis=1, kind="stable")[:, :k]
                    i, c = np.nonzero(np.take_along_axis(inside, order, 1))
                    j = order[i, c]
                else:
                    i, j = np.nonzero(inside)
                for s in range(0, len(i), MADE):
                    x, y = i[s : s + MADE], j[s : s + MADE]
                    some.append((a[x], p[y], far[x, y]))
                    n += len(x)
                    if n >= MADE:
                        yield made()
                        some, n = [], 0
            if some:
                yield made()

    return _gathered(open_, tree, 0).mapInArrow(run, T.StructType([T.StructField("query", kind["query"].dataType), T.StructField("p", p_type)]))


def _searched(tree: Tree, queries: DataFrame, k: int | None, radius: Column | None, bare: bool) -> DataFrame:
    """(query, p): what `search` gives, with further points of the leaves visited."""
    limit = F.lit(float("inf")) if radius is None else radius * radius
    state = F.struct("query", F.col("key").cast("string").alias("_k"), "at", limit.cast("double").alias("bound"))
    # so many parts, as a query is work whatever its size
    rows = queries.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query").select(state.alias("q")).where("q._k is not null and q.at is not null")
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema["q"].dataType])

    def leaves(rows: DataFrame, first: bool) -> DataFrame:
        open_ = _begun(rows, kind, tree, k, first)
        for level in range(len(tree.levels) - 1 if tree.sent is None else tree.sent[0], 0, -1):
            open_ = _down(open_, kind, tree, level, k, first)
        return open_

    if k is not None and len(tree.levels) > 1:
        rows = _bounded(leaves(rows, True), kind, tree, k)
    return _found(leaves(rows, False), kind, tree, k, bare)


def search(tree: Tree, queries: DataFrame, k: int | None = None, radius: Column | None = None, bare: bool = False) -> DataFrame:
    """(query, id, d, w, v): of each query the k nearest points of its key (ties: smallest id), those within `radius`, or both; without w and v if `bare`.

    queries: query (one row each), key, at (array of doubles), and what `radius` names, a column or a number (inclusive). A query whose key has no points has no rows."""
    columns = ["query", "p.id", "p.d"] if bare else ["query", "p.id", "p.d", "p.w", "p.v"]
    if k is None:
        return _searched(tree, queries, k, radius, bare).select(columns)
    if k == 1:
        return _searched(tree, queries, k, radius, bare).groupBy("query").agg(F.min_by("p", F.struct("p.d", "p.id")).alias("p")).select(columns)
    return lists(tree, queries, k, radius, bare).select("query", F.explode("p").alias("p")).select(columns)


def lists(tree: Tree, queries: DataFrame, k: int, radius: Column | None = None, bare: bool = False) -> DataFrame:
    """(query, p): the same, in order of distance and id as an array of structs that begin with d and id."""
    return _searched(tree, queries, k, radius, bare).groupBy("query").agg(F.slice(F.array_sort(F.collect_list("p")), 1, k).alias("p"))


def neighbourhoods(tree: Tree, radius: float, k: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What `run` makes of every leaf and all points among which the k nearest within the radius of each of its own points lie, itself and others.

    Both tables have id, v and w. A leaf and its surroundings are a group, so that a point goes to a task once for many queries, and no pair
    leaves it. Leaves meet by going down the tree: a bound for a leaf is the least distance within which boxes as a whole
    hold k points besides the point itself."""
    dims, top = tree.dims, tree.levels[-1]
    leaf = tree.levels[0].select("key", F.col("node").alias("leaf"), F.col("lo").alias("a"), F.col("hi").alias("b"))
    met = leaf.join(top.select("key", F.struct("node", "n", "lo", "hi").alias("c")), "key").withColumn("bound", F.lit(float(radius)))
    for level in range(len(tree.levels) - 1, -1, -1):
        least = F.sqrt(sum((F.pow(F.greatest(F.col("c.lo")[d] - F.col("b")[d], F.col("a")[d] - F.col("c.hi")[d], F.lit(0.0)), 2) for d in range(dims)), F.lit(0.0)))
        most = F.sqrt(sum((F.pow(F.greatest(F.col("c.hi")[d] - F.col("a")[d], F.col("b")[d] - F.col("c.lo")[d]), 2) for d in range(dims)), F.lit(0.0)))
        met = met.withColumn("_least", least).where(F.col("_least") <= F.col("bound") * (1 + SLACK)).withColumn("_most", most)
        held = F.sum("c.n").over(Window.partitionBy("key", "leaf").orderBy("_most", "c.node"))
        met = met.withColumn("_held", held).withColumn("bound", F.least("bound", F.min(F.when(F.col("_held") > k, F.col("_most"))).over(Window.partitionBy("key", "leaf"))))
        met = cut(met.where(F.col("_least") <= F.col("bound") * (1 + SLACK)).select("key", "leaf", "a", "b", "bound", "c"))
        if level:
            kids = tree.levels[level].select("key", F.col("node").alias("_node"), "kids")
            met = met.join(kids, (met["key"] == kids["key"]) & (F.col("c.node") == F.col("_node"))).select(met["key"], "leaf", "a", "b", "bound", F.explode("kids").alias("c"))
    points = tree.levels[0].select("key", F.col("node").alias("_node"), F.col("kids").alias("p"))
    rows = met.select(F.col("key").alias("_k"), "leaf", F.col("c.node").alias("at")).join(points, (F.col("_k") == F.col("key")) & (F.col("at") == F.col("_node")))

    def of_leaf(g: pa.Table) -> pa.Table:
        g = g.combine_chunks()
        mine = pc.equal(g.column("leaf"), g.column("at"))
        flat = [pa.Table.from_struct_array(t.column("p").combine_chunks().flatten()) for t in (g.filter(mine), g)]
        return run(*flat)

    return rows.select("key", "leaf", "at", "p").groupBy("key", "leaf").applyInArrow(of_leaf, schema)


def surroundings(tree: Tree, radius: float, begun: Callable[[list[tuple[np.ndarray, ...]]], Surroundings], schema: str) -> DataFrame:
    """What `begun` and its result make of every tile of up to FAN neighbouring leaves and all points within the radius of its box, its own among them. The tree has one group.

    begun(own): a tile's leaves as (ids, places, w, an array of numbers). Then the points pass by, some leaves at once, so that a task holds a
    tile and no surroundings, and a point goes to a task once for very many queries."""
    leaves, dims = tree.levels[0], tree.dims
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = max(1, min(FAN, tree.counts[0] // (4 * parts)))
    made = F.expr(f"shiftright(node, 40) * {1 << 40}L + floor((node & {(1 << 40) - 1}L) / {per})")
    flat = leaves.select(made.cast("long").alias("tile"), "node", "lo", "hi", F.col("kids.id").alias("ids"), F.flatten("kids.v").alias("v"), F.flatten("kids.w").alias("w"))
    ends = [f(F.col(c)[d]).alias(f"{c}{d}") for c, f in (("lo", F.min), ("hi", F.max)) for d in range(dims)]
    tiles = cut(flat.groupBy("tile").agg(*ends))
    gap = sum((F.pow(F.greatest(F.col("lo")[d] - F.col(f"hi{d}"), F.col(f"lo{d}") - F.col("hi")[d], F.lit(0.0)), 2) for d in range(dims)), F.lit(0.0))
    met = flat.drop("tile", "w").crossJoin(F.broadcast(tiles)).where(gap <= radius * radius * (1 + SLACK))
    own = flat.select("tile", F.lit(False).alias("passes"), "ids", "v", "w")
    rows = own.unionByName(met.select("tile", F.lit(True).alias("passes"), "ids", "v", F.lit(None).cast(dict(flat.dtypes)["w"]).alias("w")))
    rows = rows.repartition(max(1, tiles.count()), "tile").sortWithinPartitions("tile", "passes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine, held = None, [], None
        for batch in batches:
            tile, passes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            new = np.flatnonzero(np.concatenate([[True], (tile[1:] != tile[:-1]) | (passes[1:] != passes[:-1])]))
            for a, b in zip(new, [*new[1:], len(tile)], strict=True):
                if tile[a] != now:
                    if held:
                        yield held.made()
                    now, mine, held = tile[a], [], None
                if not passes[a]:
                    mine += [tuple(x.reshape(len(ids), -1) if j else x for j, x in enumerate((ids, *(batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (3, 4))))) for i in range(a, b) for ids in [batch.column(2)[i].values.to_numpy(zero_copy_only=False)]]
                    continue
                held = held or begun(mine)
                for i in range(a, b, AT_ONCE):
                    piece = batch.slice(i, min(AT_ONCE, b - i))
                    ids = piece.column(2).flatten().to_numpy(zero_copy_only=False)
                    held.add(ids, piece.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dims))
        if held:
            yield held.made()

    return rows.select("tile", "passes", "ids", "v", "w").mapInArrow(run, schema)
