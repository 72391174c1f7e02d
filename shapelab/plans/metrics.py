"""Distances of elements, feature by feature: what a pair of shapes gives to the learned distance.

Elements are those of `element_parts`; the curvatures of a point are its ninth and tenth dimension, its diameter is its
value, and the points of a curve of each type are a quarter of the shape's points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelab.functions import hist, score
from shapelab.operators import rtree, voting
from shapelab.session import stored

from .descriptors import D2_BINS
from .elements import _DIST, _PATCH, _shapes, parts, touching
from .geometry import vectors
from .matching import R, decomposed
from .measures import smooth_sql
from .registry import register, registered_sql
from .voting import _SIDE, _TURNS, nearest_both_ways, turns

#: Types of curves; what a curve gives whose distance isn't finite; the least scale that counts.
CURVES, LOST, SMALL = 4, (5.0, 2.0), 0.01


def alignment(asks: DataFrame, held: DataFrame, radius: float) -> DataFrame:
    """(key, type, position, normal): mean distance of the moved points of a key and type to the nearest held ones, in radii, and one less the mean cosine of their normals.

    One search for all types. asks, held: key, type, id, v, n."""
    group = F.concat_ws(":", "key", "type")
    tree = rtree.build(held.select(group.alias("key"), "id", "v", F.col("n").alias("w")), 3)
    near = rtree.search(tree, asks.select(F.struct("key", "type", "id", "n").alias("query"), group.alias("key"), F.col("v").alias("at")), 1)
    cosine = sum((F.col("query.n")[i] * F.col("w")[i] for i in range(3)), F.lit(0.0))
    return near.groupBy(F.col("query.key").alias("key"), F.col("query.type").alias("type")).agg((F.avg("d") / radius).alias("position"), (1 - F.avg(cosine)).alias("normal"))


def curve_points(points: DataFrame, curves: DataFrame) -> DataFrame:
    """(key, side, type, id, v, n): the curve points nearest to a key's points, each once; a key that finds no more than one takes its own first point.

    points: key, side (0 or 1), id, v, n. curves: side, type, id, v, n. One search over both sides and all types, which are the groups of the tree."""
    group, types = F.col("side") * CURVES + F.col("type"), F.explode(F.sequence(F.lit(0), F.lit(CURVES - 1)))
    tree = rtree.build(curves.select(group.alias("key"), "id", "v", F.col("n").alias("w")), 3)
    places = points.select("side", "id", "v").distinct().withColumn("type", types)
    q = places.select(F.struct("side", "id", "type").alias("query"), group.alias("key"), F.col("v").alias("at"))
    near = stored(rtree.search(tree, q, 1).select("query.side", "query.id", "query.type", F.col("id").alias("hit"), "v", F.col("w").alias("n")))
    by = ["key", "side", "type"]
    found = points.select("key", "side", "id").join(near, ["side", "id"]).groupBy(*by, "hit").agg(F.first("v").alias("v"), F.first("n").alias("n"))
    size = found.groupBy(by).agg(F.count(F.lit(1)).alias("size"))
    first = points.groupBy("key", "side").agg(F.min_by(F.struct("id", "v", "n"), "id").alias("p")).withColumn("type", types)
    alone = first.join(size.where("size > 1"), by, "left_anti").select(*by, "p.id", "p.v", "p.n")
    return found.join(size.where("size > 1"), by).select(*by, F.col("hit").alias("id"), "v", "n").unionByName(alone)


def histogram_distances(values: DataFrame) -> DataFrame:
    """(key, feature, bins, emd): earth mover's distances between the two sides of each key, for all features and sizes of histogram together. values: key, side (0 or 1), feature, v in 0..1."""
    counts = stored(values.groupBy("key", "side", "feature", "v").agg(F.count(F.lit(1)).alias("c")))
    by = ["key", "side", "feature", "bins"]
    each = counts.withColumn("bins", F.explode(F.array(*map(F.lit, D2_BINS))))
    c = hist.cumulative(hist.histogram(each, by, "v", F.col("bins"), weight="c"), by)
    gap = F.sum(F.when(F.col("side") == 0, F.col("cdf")).otherwise(-F.col("cdf")))
    return c.groupBy("key", "feature", "bins", "bin").agg(gap.alias("gap")).groupBy("key", "feature", "bins").agg(F.sum(F.abs("gap")).alias("emd"))


def patch_metrics_of(source: DataFrame, target: DataFrame, moves: DataFrame, curves: tuple[DataFrame, DataFrame], radius: float) -> DataFrame:
    """(key, metric, value): the full patch distance of each element, by name; the simple one is position, normal and the histograms.

    source, target: key, id, v, n, k1, k2 (in -1..1), sdf (in 0..1). moves: key, a (12), r (9). curves: of the source and of the target shape, type, id, v, n.
    Whole elements are the type -1 beside those of the curves, so that all of them take one search."""
    long = lambda df, **m: df.select("key", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), c.alias("value")) for k, c in m.items()])).alias("m")).select("key", "m.metric", "m.value")
    sides = lambda pair: pair[0].withColumn("side", F.lit(0)).unionByName(pair[1].withColumn("side", F.lit(1)))
    whole = sides((source, target)).select("key", "side", F.lit(-1).alias("type"), "id", "v", "n")
    every = stored(whole.unionByName(curve_points(whole.drop("type"), sides(curves))))
    mine, other = (every.where(F.col("side") == k).drop("side") for k in (0, 1))
    of = F.struct("key", "type")
    state = moves.withColumn("type", F.explode(F.sequence(F.lit(-1), F.lit(CURVES - 1)))).select(of.alias("vote"), of.alias("s"), of.alias("t"), "a", "r")
    moved = voting.moved(state, mine.withColumn("seg", of)).select("vote.key", "vote.type", F.col("q.id").alias("id"), F.col("q.x").alias("v"), F.col("q.n").alias("n"))
    close, curve = alignment(moved, other, radius), F.col("type") >= 0
    lost = curve & (F.isnan("position") | F.isnan("normal"))
    name = lambda end: F.when(curve, F.concat(F.lit("curve"), F.col("type").cast("string"), F.lit(f"_{end}"))).otherwise(F.lit(end))
    ends = F.array(*[F.struct(name(c).alias("metric"), F.when(lost, far).otherwise(F.col(c)).alias("value")) for c, far in zip(("position", "normal"), LOST, strict=True)])
    out = close.select("key", F.explode(ends).alias("m")).select("key", "m.metric", "m.value")
    scale = decomposed(moves.select(F.xxhash64("key").alias("id"), "a")).select("id", "s")
    scaled = moves.select("key", F.xxhash64("key").alias("id")).join(scale, "id")
    out = out.unionByName(long(scaled, **{f"scale{i}": F.greatest(F.abs(F.col("s")[i]), 1 / F.greatest(F.lit(SMALL), F.abs(F.col("s")[i]))) - 1 for i in range(3)}))
    m = score.curvature_metrics(F.col("k1"), F.col("k2"), unit_range=True) | {"sdf": F.col("sdf")}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("v")) for n, c in m.items()])).alias("x")
    values = sides((source, target)).select("key", "side", each).select("key", "side", "x.feature", "x.v")
    emd = histogram_distances(values).select("key", F.concat_ws("_", "feature", F.col("bins").cast("string")).alias("metric"), F.col("emd").alias("value"))
    return out.unionByName(emd)


_K = "(select vec_id as id, embedding[9]::double as k1, embedding[10]::double as k2 from embeddings)"
_METRICS = "[k1, k2, case when abs(k1) > abs(k2) then k1 else k2 end, case when abs(k1) > abs(k2) then k2 else k1 end, (k1 + k2) / 2, k1 * k2, abs(k1), abs(k2), case when abs(k1) > abs(k2) then abs(k1) else abs(k2) end, case when abs(k1) > abs(k2) then abs(k2) else abs(k1) end, abs(k1 + k2) / 2, abs(k1 * k2), (abs(k1) + abs(k2)) / 2]"


def _emds(bins: int) -> str:
    cdf = f"(select key, side, feature, bin, sum(p) over (partition by key, side, feature order by bin) as cdf from {smooth_sql('key, side, feature', 'v', 'vals', bins, 0.0, 1.0)})"
    return f"select key, feature || '_{bins}' as metric, sum(abs(gap)) as value from (select key, feature, bin, sum(case when side = 0 then cdf else -cdf end) as gap from {cdf} group by 1, 2, 3) group by 1, 2"


def _metrics_sql() -> str:
    names = [*score.CURVATURE, "sdf"]
    curve = lambda even: f"""(select z.key, z.type, c.id, c.x, c.y, c.z, c.nx, c.ny, c.nz from (select key, type, hit, count(*) over (partition by key, type) as size from (select distinct key, type, hit from
 (select e.key, c.type, e.id, c.id as hit, row_number() over (partition by e.key, c.type, e.id order by {_DIST.replace("a.", "e.").replace("b.", "c.")}, c.id) as rn from ep e join cp c on c.even = {even} where e.even = {even}) where rn = 1)) z join cp c on c.id = z.hit where size > 1)"""  # noqa: E731
    turned = _SIDE.format(o="mine", turns=_TURNS).replace("id, label, even", "id, key, of, type, even")
    best = "select key, avg(d) / {r} as position, 1 - avg(cosine) as normal from (select a.key, {d} as d, a.nx * b.nx + a.ny * b.ny + a.nz * b.nz as cosine, row_number() over (partition by a.key, a.id order by {d}, b.id) as rn from {a} a join {b} b on a.key = b.key) where rn = 1 group by 1"
    sides = " union all ".join(
        f"select key, 'curve{k}_' || unnest(['position', 'normal']) as metric, unnest([position, normal]) as value from ({best.format(r=R, d=_DIST, a=f'(select * from moved where type = {k})', b=f'(select * from tc where type = {k})')})" for k in range(CURVES)
    )
    return f"""with parts as (select mode * 1000 + element as key, mode, side, patch from ({registered_sql("element_parts")})), pt as {_PATCH}, kk as {_K},
 ep as (select p.key, p.mode as of, pt.*, id % 2 = 0 as even from parts p join pt on pt.patch = p.patch and (pt.id % 2 = 0) = (p.side = 'source')),
 cp as (select *, id % 2 = 0 as even, (id // 2) % {CURVES} as type from pt),
 sc as {curve("true")}, tc0 as {curve("false")},
 firsts as (select key, even, arg_min(id, id) as id from ep group by 1, 2),
 lone as (select f.key, t.type, f.even, pt.id, x, y, z, nx, ny, nz from firsts f join pt on pt.id = f.id, (select unnest(range({CURVES})) as type) t
  where not exists (select 1 from sc where f.even and sc.key = f.key and sc.type = t.type) and not exists (select 1 from tc0 where not f.even and tc0.key = f.key and tc0.type = t.type)),
 tc as (select * from tc0 union all select key, type, id, x, y, z, nx, ny, nz from lone where not even),
 mine as (select key, -1 as type, of, id, x, y, z, nx, ny, nz from ep where even union all select key, type, key // 1000 as of, id, x, y, z, nx, ny, nz from (select * from sc union all select key, type, id, x, y, z, nx, ny, nz from lone where even)),
 moved as (select * from {turned} where even and mode = of),
 vals as (select key, case when even then 0 else 1 end as side, unnest({names}) as feature, unnest(list_append(list_transform({_METRICS}, lambda x, i: case when i <= 6 then (x + 1) / 2 else x end), value)) as v from ep join kk using (id)),
 every as (select key, unnest(['position', 'normal']) as metric, unnest([position, normal]) as value from ({best.format(r=R, d=_DIST, a="(select * from moved where type = -1)", b="(select * from ep where not even)")})
 union all {sides} union all select key, 'scale' || unnest(range(3)), 0.0 from (select distinct key from parts) union all {" union all ".join(map(_emds, D2_BINS))})
 select (key // 1000)::int as mode, (key % 1000)::bigint as element, metric, round(value, 5) as value from every"""


@register(_metrics_sql())
def patch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the patch distances of all elements: positions, normals, curves, scales, curvatures and diameters."""
    source, target = _shapes(spark, sf_dir)
    k = vectors(spark, sf_dir).select("id", F.col("v")[8].alias("k1"), F.col("v")[9].alias("k2"), F.abs(F.col("v")[7]).alias("sdf"))
    t = stored(turns(spark))
    near = stored(nearest_both_ways(source, target, t))
    patches = source.select("patch").distinct().withColumn("mode", F.explode(F.sequence(F.lit(0), F.lit(4))))
    labels = stored(patches.where("(patch * 7 + mode * 3) % 4 > 1").select("mode", "patch"))
    found = stored(parts(near, source, target, touching(source), labels).withColumn("key", F.col("mode") * 1000 + F.col("element")))
    if found.isEmpty():
        return spark.createDataFrame([], "mode int, element long, metric string, value double")
    own = lambda p, side: stored(found.where(F.col("side") == side).select("key", "patch").join(p, "patch").join(k, "id").select("key", "id", "v", "n", "k1", "k2", "sdf"))
    curves = tuple(p.select((F.floor(F.col("id") / 2) % CURVES).cast("int").alias("type"), "id", "v", "n") for p in (source, target))
    moves = found.select("key", "mode").distinct().join(t, "mode").select("key", "a", "r")
    m = patch_metrics_of(own(source, "source"), own(target, "target"), moves, curves, R)
    return m.select(F.floor(F.col("key") / 1000).cast("int").alias("mode"), (F.col("key") % 1000).cast("long").alias("element"), "metric", F.round("value", 5).alias("value"))
