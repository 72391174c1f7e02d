"""Elements from labelled patches, and the energies that labels are chosen by.

Matches are those of `both_ways`: the even shape under five transforms and the odd one. Patches are quarters of segments; two of
the even shape touch if a point of one has its nearest other point in the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelab.operators import rtree, spatial
from shapelab.operators.graph import components
from shapelab.session import stored

from .descriptors import _O, oriented
from .matching import R
from .registry import register
from .voting import _SIDE, _TURNS, _both_ways_sql, nearest_both_ways, turns

#: Share of a target patch's points that have to map back; matched points that a patch needs; how much dearer than the dearest a patch without them is; distance unit.
COVERAGE, LEAST, UNMATCHED, UNIT = 0.5, 3, 5.0, 4.0


def touching(points: DataFrame) -> DataFrame:
    """(p, q) in both directions: patches of which a point has its nearest other point in the other one. points: id, patch, x, y, z."""
    near = spatial.nearest_on_grid(points.select("id", "x", "y", "z"), points.select(F.col("id").alias("query"), "x", "y", "z"), 1, R)
    of = lambda c, name: points.select(F.col("id").alias(c), F.col("patch").alias(name))
    e = near.join(of("query", "p"), "query").join(of("id", "q"), "id").where("p <> q").select("p", "q")
    return stored(e.unionByName(e.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct())


def parts(near: DataFrame, source: DataFrame, target: DataFrame, graph: DataFrame, labels: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(mode, element, side, patch): under each transform the connected sets of labelled source patches, with the target patches that they are matched with.

    A target patch is matched if a source point of the set hits it, and at least `coverage` of its own points hit the set. A set without any is no element.
    near: mode, forward, id, hit. source, target: id, patch. graph: p, q. labels: mode, patch (those labelled, each once)."""
    e = graph.join(labels.select("mode", F.col("patch").alias("p")), "p").join(labels.select("mode", F.col("patch").alias("q")), ["mode", "q"])
    joined = components(e.select(F.struct("mode", F.col("p").alias("patch")).alias("u"), F.struct("mode", F.col("q").alias("patch")).alias("v")))
    sets = labels.join(joined.select("node.mode", "node.patch", F.col("component.patch").alias("element")), ["mode", "patch"], "left")
    sets = stored(sets.select("mode", "patch", F.coalesce("element", "patch").alias("element")))
    s, t = source.select("id", "patch"), target.select("id", F.col("patch").alias("there"))
    hit = lambda p: p.withColumnRenamed("id", "hit")
    touched = near.where("forward").join(s, "id").join(hit(t), "hit").join(sets, ["mode", "patch"]).select("mode", "element", "there").distinct()
    back = near.where("not forward").join(t, "id").join(hit(s), "hit").join(sets, ["mode", "patch"]).groupBy("mode", "element", "there").agg(F.count(F.lit(1)).alias("n"))
    size = t.groupBy("there").agg(F.count(F.lit(1)).alias("size"))
    matched = stored(touched.join(back, ["mode", "element", "there"]).join(size, "there").where(F.col("n") >= coverage * F.col("size")).select("mode", "element", "there"))
    whole = sets.join(matched.select("mode", "element").distinct(), ["mode", "element"], "left_semi")
    side = lambda df, c, name: df.select("mode", "element", F.lit(name).alias("side"), F.col(c).alias("patch"))
    return side(whole, "patch", "source").unionByName(side(matched, "there", "target"))


def _patch_distance(asks: DataFrame, held: DataFrame, by: list[str], radius: float) -> DataFrame:
    """(by, spd): mean distance of each group's points to the nearest held ones of the group, in radii, and of the normals. asks, held: key, id, v, n; asks has `by` too."""
    tree = rtree.build(held.select("key", "id", "v", F.col("n").alias("w")), 3)
    near = rtree.search(tree, asks.select(F.struct(*by, "id", "n").alias("query"), "key", F.col("v").alias("at")), 1)
    cosine = sum((F.col("query.n")[i] * F.col("w")[i] for i in range(3)), F.lit(0.0))
    return near.groupBy(*[F.col(f"query.{c}").alias(c) for c in by]).agg((F.avg("d") / radius + 1 - F.avg(cosine)).alias("spd"))


def log_term(x: Column) -> Column:
    return F.greatest(F.lit(0.0), -F.log(1 - F.exp(-x) + 1e-5))


def unary(near: DataFrame, moved: DataFrame, source: DataFrame, target: DataFrame, least: int = LEAST, unit: float = UNIT) -> DataFrame:
    """(mode, p, term1, term0): costs of labelling and of not labelling each source patch under each transform.

    A patch is held against the target points of the patches that it hits which hit it back; with fewer than `least` of them it costs UNMATCHED times the transform's dearest one.
    near: mode, forward, id, hit. moved: mode, id, v, n. source: id, patch. target: id, patch, v, n."""
    s, t = source.select("id", "patch"), target.select("id", F.col("patch").alias("there"))
    hit = lambda p: p.withColumnRenamed("id", "hit")
    touched = near.where("forward").join(s, "id").join(hit(t), "hit").select("mode", "patch", "there").distinct()
    back = near.where("not forward").join(t, "id").join(hit(s), "hit").select("mode", "patch", "there", "id")
    points = stored(back.join(touched, ["mode", "patch", "there"], "left_semi"))
    enough = points.groupBy("mode", "patch").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("mode", "patch")
    key = F.concat_ws(":", "mode", "patch").alias("key")
    held = points.join(enough, ["mode", "patch"]).join(target.select("id", "v", "n"), "id").select(key, "id", "v", "n")
    asks = moved.join(s, "id").join(enough, ["mode", "patch"]).select(key, "mode", "patch", "id", "v", "n")
    known = stored(_patch_distance(asks, held, ["mode", "patch"], R).select("mode", "patch", (F.col("spd") / unit).alias("t")))
    most = known.groupBy("mode").agg(F.max("t").alias("most"))
    every = moved.join(s, "id").select("mode", "patch").distinct()
    dear = F.when(F.coalesce("most", F.lit(0.0)) > 0, F.col("most") * UNMATCHED)
    out = every.join(known, ["mode", "patch"], "left").join(most, "mode", "left").withColumn("term1", F.coalesce("t", dear, F.lit(1e7)))
    term0 = F.when(F.col("t").isNull() & dear.isNull(), 0.0).otherwise(log_term(F.col("term1")))
    return out.select("mode", F.col("patch").alias("p"), "term1", term0.alias("term0"))


def pairwise(source: DataFrame, graph: DataFrame, unit: float = UNIT) -> DataFrame:
    """(p, q, term): cost of labelling one of two touching patches alone: high if the one is like the other when their boxes' centres are brought together. source: id, patch, v, n."""
    ends = [(F.min(F.col("v")[i]) + F.max(F.col("v")[i])) / 2 for i in range(3)]
    centre = source.groupBy("patch").agg(F.array(*ends).alias("c"))
    degree = graph.groupBy("p").agg(F.count(F.lit(1)).alias("degree"))
    of = lambda name: centre.join(degree, centre["patch"] == degree["p"]).select(F.col("patch").alias(name), F.col("c").alias(f"c{name}"), F.col("degree").alias(f"d{name}"))
    pairs = stored(graph.where("p < q").join(of("p"), "p").join(of("q"), "q"))
    moved = F.array(*[F.col("v")[i] + F.col("cq")[i] - F.col("cp")[i] for i in range(3)])
    asks = source.select(F.col("patch").alias("p"), "id", "v", "n").join(pairs, "p").select(F.col("q").alias("key"), "p", "q", "id", moved.alias("v"), "n")
    spd = _patch_distance(asks, source.select(F.col("patch").alias("key"), "id", "v", "n"), ["p", "q"], R)
    half = F.greatest(F.lit(1), F.floor((F.col("dp") + F.col("dq")) / 2))
    return spd.join(pairs.select("p", "q", "dp", "dq"), ["p", "q"]).select("p", "q", (log_term(F.col("spd") / unit) / half).alias("term"))


def _shapes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    patch = F.col("label") * 4 + F.floor(F.col("id") / 2) % 4
    o = oriented(spark, sf_dir).select(F.lit(0).alias("seg"), "id", patch.cast("long").alias("patch"), F.array("p.x", "p.y", "p.z").alias("v"), F.array("n.x", "n.y", "n.z").alias("n"), "x", "y", "z")
    return stored(o.where("id % 2 = 0")), stored(o.where("id % 2 = 1"))


_PATCH = f"(select *, (label * 4 + (id // 2) % 4)::bigint as patch from {_O})"
_DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_WITH = f"""with recursive near as ({_both_ways_sql()}), pt as {_PATCH},
 firsts as (select s, t from (select a.id as s, b.id as t, row_number() over (partition by a.id order by {_DIST}, b.id) as rn from pt a join pt b on a.id % 2 = 0 and b.id % 2 = 0 and a.id <> b.id) where rn = 1),
 touch as (select a.patch as p, b.patch as q from firsts join pt a on a.id = s join pt b on b.id = t where a.patch <> b.patch), graph as (select p, q from touch union select q, p from touch)"""
_LABELS = "(select mode, patch from (select distinct patch from pt where id % 2 = 0), (select unnest(range(5))::int as mode) where (patch * 7 + mode * 3) % 4 > 1)"


@register(_WITH + f""", labels as {_LABELS},
 edges as (select l.mode, g.p, g.q from graph g join labels l on l.patch = g.p join labels m on m.patch = g.q and m.mode = l.mode),
 reach(mode, n, m) as (select mode, patch, patch from labels union select r.mode, r.n, e.q from reach r join edges e on e.mode = r.mode and e.p = r.m),
 sets as (select mode, n as patch, min(m) as element from reach group by 1, 2),
 touched as (select distinct n.mode, s.element, b.patch as there from near n join pt a on a.id = n.id join pt b on b.id = n.hit join sets s on s.mode = n.mode and s.patch = a.patch where n.forward),
 back as (select n.mode, s.element, a.patch as there, count(*) as n from near n join pt a on a.id = n.id join pt b on b.id = n.hit join sets s on s.mode = n.mode and s.patch = b.patch where not n.forward group by all),
 sizes as (select patch as there, count(*) as size from pt where id % 2 = 1 group by 1),
 matched as (select mode, element, there from touched join back using (mode, element, there) join sizes using (there) where n >= {COVERAGE} * size)
 select mode, element, 'target' as side, there as patch from matched union all select mode, element, 'source', patch from sets where (mode, element) in (select mode, element from matched)""")
def element_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of patches that a fixed rule labels: source sets and the target patches they are matched with."""
    source, target = _shapes(spark, sf_dir)
    near = stored(nearest_both_ways(source, target, turns(spark)))
    patches = source.select("patch").distinct().withColumn("mode", F.explode(F.array(*[F.lit(m) for m in range(5)])))
    labels = stored(patches.where("(patch * 7 + mode * 3) % 4 > 1").select("mode", "patch"))
    return parts(near, source, target, touching(source), labels)


@register(_WITH + f""", moved as {_SIDE.format(o=_PATCH, turns=_TURNS).replace("id, label, even", "id, patch, even")},
 points as (select distinct n.mode, b.patch, a.id from near n join pt a on a.id = n.id join pt b on b.id = n.hit where not n.forward and (n.mode, b.patch, a.patch) in (select m.mode, c.patch, d.patch from near m join pt c on c.id = m.id join pt d on d.id = m.hit where m.forward)),
 enough as (select mode, patch from points group by 1, 2 having count(*) >= {LEAST}),
 hits as (select a.mode, a.patch, a.id, {_DIST} as d, a.nx * b.nx + a.ny * b.ny + a.nz * b.nz as cosine, row_number() over (partition by a.mode, a.id order by {_DIST}, b.id) as rn
  from moved a join enough using (mode, patch) join points p on p.mode = a.mode and p.patch = a.patch join pt b on b.id = p.id where a.even),
 known as (select mode, patch, (avg(d) / {R} + 1 - avg(cosine)) / {UNIT} as t from hits where rn = 1 group by 1, 2),
 terms as (select mode, patch, t, case when max(t) over (partition by mode) > 0 then max(t) over (partition by mode) * {UNMATCHED} end as dear from (select distinct mode, patch from moved where even) left join known using (mode, patch)),
 costs as (select *, coalesce(t, dear, 1e7) as term1 from terms),
 boxes as (select patch, (min(x) + max(x)) / 2 as cx, (min(y) + max(y)) / 2 as cy, (min(z) + max(z)) / 2 as cz, (select count(*) from graph where p = patch) as degree from pt where id % 2 = 0 group by 1),
 shifted as (select g.p, g.q, pt.id, x + bq.cx - bp.cx as x, y + bq.cy - bp.cy as y, z + bq.cz - bp.cz as z, nx, ny, nz, greatest(1, (bp.degree + bq.degree) // 2) as half from graph g join boxes bp on bp.patch = g.p join boxes bq on bq.patch = g.q join pt on pt.patch = g.p and pt.id % 2 = 0 where g.p < g.q),
 pair_hits as (select a.p, a.q, a.half, {_DIST} as d, a.nx * b.nx + a.ny * b.ny + a.nz * b.nz as cosine, row_number() over (partition by a.p, a.q, a.id order by {_DIST}, b.id) as rn from shifted a join pt b on b.patch = a.q and b.id % 2 = 0),
 pair_terms as (select p, q, (avg(d) / {R} + 1 - avg(cosine)) / {UNIT} as t, max(half) as half from pair_hits where rn = 1 group by 1, 2)
 select mode::int as mode, patch as p, null::bigint as q, round(term1, 5) as term1, round(case when t is null and dear is null then 0 else greatest(0, -ln(1 - exp(-term1) + 1e-5)) end, 5) as term0 from costs
 union all select null::int, p, q, round(greatest(0, -ln(1 - exp(-t) + 1e-5)) / half, 5), null from pair_terms""")
def energy_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms of the labelling energy: of each patch under each transform, and of each two touching patches (term1)."""
    from shapelab.operators import voting

    source, target = _shapes(spark, sf_dir)
    t = turns(spark)
    near = stored(nearest_both_ways(source, target, t))
    state = t.select(F.col("mode").alias("vote"), F.col("seg").alias("s"), F.col("seg").alias("t"), "a", "r")
    moved = stored(voting.moved(state, source).select(F.col("vote").alias("mode"), "q.id", F.col("q.x").alias("v"), F.col("q.n").alias("n")))
    one = unary(near, moved, source, target).select("mode", "p", F.lit(None).cast("long").alias("q"), F.round("term1", 5).alias("term1"), F.round("term0", 5).alias("term0"))
    two = pairwise(source, touching(source)).select(F.lit(None).cast("int").alias("mode"), "p", "q", F.round("term", 5).alias("term1"), F.lit(None).cast("double").alias("term0"))
    return one.unionByName(two)
