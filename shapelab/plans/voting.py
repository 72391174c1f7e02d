"""From segments to modes: votes by alignment, their distances and weights, mean shift in transform space, and pruning.

Points and normals are those of `descriptors`, labels are segments; the even ids are one shape and the odd ones the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelab.functions import hist, rank
from shapelab.operators import modes, rtree, voting
from shapelab.session import stored, table

from .descriptors import D2_BINS, oriented
from .matching import R, decomposed
from .registry import register

#: Share of votes whose distance is the unit of weights, and how many such units.
PERCENTILE, SIGMA = 0.5, 1.0


def segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The points of both shapes: seg, id, v, n, value."""
    o = oriented(spark, sf_dir).select(F.col("label").alias("seg"), "id", F.array("p.x", "p.y", "p.z").alias("v"), F.array("n.x", "n.y", "n.z").alias("n"), "value")
    return o.where("id % 2 = 0"), o.where("id % 2 = 1")


def valid_votes(votes: DataFrame) -> DataFrame:
    """Votes with their shift, turn and scales (td, q, sc), of which each scale lies in bounds."""
    parts = decomposed(votes.select(F.col("vote").alias("id"), "a")).select(F.col("id").alias("vote"), F.col("t").alias("td"), "q", F.col("s").alias("sc"))
    ok = F.forall("sc", lambda x: F.abs(x).between(*voting.SCALES)) & F.forall("a", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return votes.join(parts, "vote").where(ok)


def vote_distances(votes: DataFrame, source: DataFrame, target: DataFrame, radius: float) -> DataFrame:
    """Adds `spd`: the simple patch distance of each vote. It is the sum of the mean distance of the moved points in radii, that of the normals, and
    the earth mover's distances of the segments' values at four sizes of histogram; votes: vote, s, t, a, r."""
    near = voting.distances_of_pairs(votes, source, target)
    cdfs = []
    for side in (source, target):
        each = None
        for bins in D2_BINS:
            h = hist.cumulative(hist.histogram(side.select("seg", "value"), ["seg"], "value", bins), ["seg"]).select("seg", F.lit(bins).alias("bins"), "bin", "cdf")
            each = h if each is None else each.unionByName(h)
        cdfs.append(each.groupBy("seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("bins", "bin", "cdf"))), lambda x: x["cdf"]).alias("c")))
    pairs = votes.select("s", "t").distinct().join(cdfs[0].select(F.col("seg").alias("s"), F.col("c").alias("cs")), "s").join(cdfs[1].select(F.col("seg").alias("t"), F.col("c").alias("ct")), "t")
    values = pairs.select("s", "t", F.aggregate(F.zip_with("cs", "ct", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda x, y: x + y).alias("values"))
    return votes.join(near, "vote").join(values, ["s", "t"]).withColumn("spd", F.col("position") / radius + F.col("normal") + F.col("values")).drop("position", "normal", "n", "values")


def weighted(votes: DataFrame, sizes: DataFrame, sigma: float = SIGMA) -> tuple[DataFrame, float]:
    """Adds `w`, a vote's share of exp(-spd / unit) times the points of its source segment, and the unit: the spd at PERCENTILE, times sigma."""
    unit = rank.nth_quantile(votes, [], "spd", PERCENTILE).first()
    unit = float(unit[0]) * sigma if unit else 1.0
    w = votes.join(sizes.select(F.col("seg").alias("s"), F.col("size").alias("area")), "s").withColumn("w", F.exp(-F.col("spd") / unit) * F.col("area"))
    total = w.agg(F.sum("w")).first()[0] or 1.0
    return w.withColumn("w", F.col("w") / total), unit


def global_vote(source: DataFrame, target: DataFrame) -> DataFrame:
    """The alignment of the whole shapes from where they are, as a vote whose segments are -1."""
    whole = [p.withColumn("seg", F.lit(-1)) for p in (source, target)]
    pair = voting.frames(whole[0], R).select(F.struct("*").alias("s")).join(voting.frames(whole[1], R).select(F.struct("*").alias("t")), F.col("s.seg") == F.col("t.seg"))
    first = voting.begun(pair).where("start = 0").withColumn("vote", F.lit(-1).cast("long"))
    return voting.icp_of_pairs(first, *whole).drop("first")


@register()
def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid alignments of all similar pairs of segments, from five starts, on all their points."""
    v = valid_votes(voting.votes(*segments(spark, sf_dir), R))
    return v.select(F.col("s").alias("source"), F.col("t").alias("target"), "start", *[F.round(F.col(c)[i], 4).alias(f"{c[0]}{i}") for c, n in (("td", 3), ("q", 4), ("sc", 3)) for i in range(n)])


def vote_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, float]:
    """The weighted votes with the mode of each, the global vote, and the unit of distance."""
    source, target = (stored(p) for p in segments(spark, sf_dir))
    v = stored(valid_votes(stored(voting.votes(source, target, R))))
    v = stored(vote_distances(v, source, target, R))
    v, unit = weighted(v, source.groupBy("seg").agg(F.count(F.lit(1)).alias("size")))
    ends = target.agg(*[f(F.col("v")[i]) for i in range(3) for f in (F.min, F.max)]).first()
    scale = sum((ends[2 * i + 1] - ends[2 * i]) ** 2 for i in range(3)) ** 0.5
    nine = F.concat(F.transform("td", lambda x: x / scale), F.slice("q", 1, 3), F.col("sc"))
    v = stored(v.withColumn("nine", nine))
    found = modes.mean_shift(v.select(F.lit(0).alias("key"), F.col("vote").alias("id"), F.col("nine").alias("v"), "w"), 9)
    areas = target.groupBy(F.col("seg").alias("t")).agg(F.count(F.lit(1)).alias("area_t"))
    return v.join(found.select(F.col("id").alias("vote"), "mode"), "vote").join(areas, "t"), stored(global_vote(source, target)), unit


@register()
def vote_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes of the votes that pruning keeps, the whole alignment first, with the number of votes that climbed to each."""
    v, whole, unit = vote_clusters(spark, sf_dir)
    v = stored(v)
    heads = v.join(v.select(F.col("mode").alias("vote")).distinct(), "vote", "left_semi").withColumn("weight", F.exp(-F.col("spd") / unit) * (F.col("area") + F.col("area_t")) / 2)
    pinned = decomposed(whole.select(F.col("vote").alias("id"), "a")).select("id", F.lit(True).alias("pinned"), F.lit(0.0).alias("weight"), "t", "q", "s")
    rows = heads.select(F.col("vote").alias("id"), F.lit(False).alias("pinned"), "weight", F.col("td").alias("t"), "q", F.col("sc").alias("s")).unionByName(pinned).withColumn("key", F.lit(0))
    kept = modes.pruned(rows, R)
    count = v.groupBy(F.col("mode").alias("id")).agg(F.count(F.lit(1)).alias("votes"))
    named = kept.join(v.select(F.col("vote").alias("id"), "s", F.col("t").alias("target"), "start"), "id", "left").join(count, "id", "left").join(rows.select("id", "weight"), "id")
    return named.select("rank", F.coalesce("s", F.lit(-1)).alias("source"), F.coalesce("target", F.lit(-1)).alias("target"), F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("votes", F.lit(0)).cast("long").alias("votes"), F.round("weight", 5).alias("weight"))


_RADIUS = 0.25
_TURN = "(l_suppkey % 5) * 4 * pi() / 180"
_MODES = f"""(select *, id = min(id) over (partition by key) as pinned from (select l_partkey as key, l_orderkey * 8 + l_linenumber as id, l_extendedprice as weight, l_quantity / 10 as t1, l_discount * 10 as t2, l_tax * 10 as t3,
 {_TURN} as turn, 1 + (l_linenumber % 3) * 0.06 as s1, case when l_linenumber = 7 then 6.0 else 1.0 end as s2 from lineitem))"""


@register(f"""with recursive r as (select *, row_number() over (partition by key order by pinned desc, weight desc, id) as i from {_MODES} where pinned or s2 <= 5),
 scan as (select key, i, [{{'id': id, 't1': t1, 't2': t2, 't3': t3, 'turn': turn, 's1': s1, 's2': s2}}] as kept from r where i = 1
 union all select s.key, r.i, case when len(list_filter(s.kept, lambda k: sqrt((k.t1 - r.t1) * (k.t1 - r.t1) + (k.t2 - r.t2) * (k.t2 - r.t2) + (k.t3 - r.t3) * (k.t3 - r.t3)) < {2 * _RADIUS} and abs(k.turn - r.turn) < 5 * pi() / 180
  and r.s1 / k.s1 < 1.1 and r.s1 / k.s1 > 1 / 1.1 and r.s2 / k.s2 < 1.1 and r.s2 / k.s2 > 1 / 1.1)) > 0 then s.kept
  else list_append(s.kept, {{'id': r.id, 't1': r.t1, 't2': r.t2, 't3': r.t3, 'turn': r.turn, 's1': r.s1, 's2': r.s2}}) end as kept from scan s join r on r.key = s.key and r.i = s.i + 1)
 select key, k.id as id, (row_number() over (partition by key order by k.at) - 1)::int as rank from (select key, unnest(list_zip(kept, range(len(kept)))) as z from (select key, arg_max(kept, i) as kept from scan group by key)) x, lateral (select {{'id': z[1].id, 'at': z[2]}} as k)""")
def mode_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes by weight, the first of a group pinned, without those like one before in shift, turn and scale. Parts stand for pairs of shapes and their lines for modes."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").cast("double").alias("weight"), "l_quantity", "l_discount", "l_tax", "l_suppkey", "l_linenumber")
    first = li.groupBy("key").agg(F.min("id").alias("first"))
    half = (F.col("l_suppkey") % 5) * 4 * F.pi() / 180 / 2
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = li.join(first, "key").select(
        "key", "id", "weight", (F.col("id") == F.col("first")).alias("pinned"),
        F.array(*[x.cast("double") for x in (F.col("l_quantity") / 10, F.col("l_discount") * 10, F.col("l_tax") * 10)]).alias("t"),
        F.array(zero, F.sin(half), zero, F.cos(half)).alias("q"),
        F.array(1 + (F.col("l_linenumber") % 3) * 0.06, F.when(F.col("l_linenumber") == 7, 6.0).otherwise(1.0), one).alias("s"),
    )
    return modes.pruned(rows, _RADIUS)


_M = 5
#: Five transforms: a turn about the third axis, and a shift along the first.
_TURNS = "(select k as mode, cos(k * 0.4) as c, sin(k * 0.4) as s, k * 0.02 as shift from (select unnest(range(5)) as k))"
_SIDE = """(select mode, id, label, even, case when even then x * c - y * s + shift else x end as x, case when even then x * s + y * c else y end as y, z,
 case when even then nx * c - ny * s else nx end as nx, case when even then nx * s + ny * c else ny end as ny, nz from (select *, id % 2 = 0 as even from {o}), {turns})"""


def _both_ways_sql() -> str:
    from .descriptors import _O

    side = _SIDE.format(o=_O, turns=_TURNS)
    d = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
    return f"""with p as {side}, near as (select a.mode, a.even, a.id, b.id as hit, a.nx * b.nx + a.ny * b.ny + a.nz * b.nz as cosine, sqrt({d}) as d, row_number() over (partition by a.mode, a.id order by {d}, b.id) as rn
 from p a join p b on a.mode = b.mode and a.even <> b.even)
 select mode::int as mode, even as forward, id, hit, round(d, 6) as d from (select *, count(*) over (partition by mode, even, hit) as hits from near where rn = 1) where hits <= 10 and cosine > 0"""


def nearest_both_ways(source: DataFrame, target: DataFrame, transforms: DataFrame) -> DataFrame:
    """(mode, forward, id, hit, d): under every transform the nearest target point of each source point, and back; without those whose hit more than ten share, or that face another way.

    One search for all transforms of all pairs, both ways. The target is one group for each pair, which all moved points ask; each moved source is a group.
    source, target: seg (the pair), id, v, n; transforms: mode (unique), seg, a (12), r (9)."""
    state = transforms.select(F.col("mode").alias("vote"), F.col("seg").alias("s"), F.col("seg").alias("t"), "a", "r")
    there = stored(voting.moved(state, source).select(F.col("vote").alias("mode"), "t", "q.id", F.col("q.x").alias("v"), F.col("q.n").alias("n")))
    still = stored(target.select("seg", "id", "v", "n"))
    dot = sum((F.col("query.n")[i] * F.col("w")[i] for i in range(3)), F.lit(0.0))
    held, asks = None, None
    for forward in (True, False):
        points, name = (still, "seg") if forward else (there, "mode")
        own = there.withColumnRenamed("t", "seg") if forward else still.join(transforms.select("mode", "seg"), "seg")
        group = F.concat_ws(":", F.lit(forward).cast("string"), name).alias("key")
        q = own.select(F.struct(F.lit(forward).alias("forward"), "mode", "id", "n").alias("query"), group, F.col("v").alias("at"))
        p = points.select(group, "id", "v", F.col("n").alias("w"))
        held, asks = (p, q) if held is None else (held.unionByName(p), asks.unionByName(q))
    near = stored(rtree.search(rtree.build(held, 3), asks, 1).select("query.forward", "query.mode", "query.id", F.col("id").alias("hit"), "d", dot.alias("cosine")))
    hubs = near.groupBy("forward", "mode", "hit").agg(F.count(F.lit(1)).alias("hits")).where("hits > 10").select("forward", "mode", "hit")
    return near.where("cosine > 0").join(hubs, ["forward", "mode", "hit"], "left_anti").select("mode", "forward", "id", "hit", "d")


def turns(spark: SparkSession) -> DataFrame:
    """(mode, seg, a, r): five turns about the third axis, with shifts along the first."""
    c, s, zero, one = F.cos(F.col("mode") * 0.4), F.sin(F.col("mode") * 0.4), F.lit(0.0), F.lit(1.0)
    t = spark.range(_M).select(F.col("id").cast("int").alias("mode"))
    return t.select("mode", F.lit(0).alias("seg"), F.array(c, -s, zero, F.col("mode") * 0.02, s, c, zero, zero, zero, zero, one, zero).alias("a"), F.array(c, -s, zero, s, c, zero, zero, zero, one).alias("r"))


@register(_both_ways_sql())
def both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest points of the even shape in the odd one, and back, under five transforms."""
    o = oriented(spark, sf_dir).select(F.lit(0).alias("seg"), "id", F.array("p.x", "p.y", "p.z").alias("v"), F.array("n.x", "n.y", "n.z").alias("n"))
    return nearest_both_ways(o.where("id % 2 = 0"), o.where("id % 2 = 1"), turns(spark)).withColumn("d", F.round("d", 6))
