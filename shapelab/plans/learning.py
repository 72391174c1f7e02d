"""Queries on triplets: which of B and C is nearer to A?

A triplet is an order with at least three parts, of which the three smallest keys are a, b and c. Parts are
described by price and size. The answer and its confidences are functions of the order's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelab.functions import rank, score
from shapelab.operators import sets
from shapelab.session import table

from .measures import hazen_sql
from .registry import register

WEIGHTS = {"price": 1.0, "size": 2.0}
LAMBDA = 0.001


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("s")).where("size(s) >= 3")
    return s.select(F.col("l_orderkey").alias("t"), F.col("s")[0].alias("a"), F.col("s")[1].alias("b"), F.col("s")[2].alias("c"), (1 + F.col("l_orderkey") % 2).cast("int").alias("answer"), (1 + F.col("l_orderkey") % 3).cast("double").alias("w1"), (1 + F.col("l_orderkey") % 5).cast("double").alias("w2"))


_T = """(select l_orderkey as t, s[1] as a, s[2] as b, s[3] as c, (1 + l_orderkey % 2)::int as answer, (1 + l_orderkey % 3)::double as w1, (1 + l_orderkey % 5)::double as w2
 from (select l_orderkey, list_sort(list(distinct l_partkey)) as s from lineitem group by 1) where len(s) >= 3)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p, price, size), scaled by their 90th percentiles and clamped."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.col("p_retailprice").cast("double").alias("price"), F.col("p_size").cast("double").alias("size"))
    scales = [rank.hazen(p, [], c, 0.9).first() for c in ("price", "size")]  # two numbers
    return p.select("p", *[score.scaled(F.col(c), F.lit(q[0] if q else 1.0)).alias(c) for c, q in zip(("price", "size"), scales)])


_F = f"""(select p_partkey as p, least(p_retailprice / case when x.q = 0 then 1 else x.q end, 1) as price, least(p_size::double / case when y.q = 0 then 1 else y.q end, 1) as size
 from part, {hazen_sql('part', 'p_retailprice', 0.9)} x, {hazen_sql('part', 'p_size', 0.9)} y)"""


def distances(spark: SparkSession, sf_dir: str, t: DataFrame | None = None) -> DataFrame:
    """Triplets with d_ab and d_ac, weighted L1 distances of the features."""
    f = features(spark, sf_dir)
    t = triplets(spark, sf_dir) if t is None else t
    for k in "abc":
        t = t.join(f.select(F.col("p").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in WEIGHTS]), k)
    d = lambda k: sum((w * F.abs(F.col(f"{c}_a") - F.col(f"{c}_{k}")) for c, w in WEIGHTS.items()), F.lit(0.0))
    return t.select("t", "a", "b", "c", "answer", "w1", "w2", d("b").alias("d_ab"), d("c").alias("d_ac"))


_D = f"""(select t, t.a, t.b, t.c, answer, w1, w2, abs(x.price - y.price) + 2 * abs(x.size - y.size) as d_ab, abs(x.price - z.price) + 2 * abs(x.size - z.size) as d_ac
 from {_T} t join {_F} x on x.p = t.a join {_F} y on y.p = t.b join {_F} z on z.p = t.c)"""


@register(f"select t, case when round(d_ab, 9) <= round(d_ac, 9) then 1 else 2 end as predicted, round(d_ab, 6) as d_ab, round(d_ac, 6) as d_ac from {_D}")
def triplet_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearer one; a tie is B."""
    d = distances(spark, sf_dir)
    return d.select("t", F.when(F.round("d_ab", 9) <= F.round("d_ac", 9), 1).otherwise(2).alias("predicted"), F.round("d_ab", 6).alias("d_ab"), F.round("d_ac", 6).alias("d_ac"))


@register(f"select answer, count(*) as n, round(avg(case when (case when round(d_ab, 9) <= round(d_ac, 9) then 1 else 2 end) = answer then 1.0 else 0.0 end), 6) as accuracy from {_D} group by 1")
def triplet_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.round("d_ab", 9) <= F.round("d_ac", 9), 1).otherwise(2)
    return distances(spark, sf_dir).groupBy("answer").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((p == F.col("answer")).cast("double")), 6).alias("accuracy"))


def _swapped(d: DataFrame) -> DataFrame:
    """Distances to the right and to the wrong answer."""
    two = F.col("answer") == 2
    pick = lambda x, y: F.when(two, F.col(y)).otherwise(F.col(x))
    return d.select("t", "w1", pick("d_ab", "d_ac").alias("right"), pick("d_ac", "d_ab").alias("wrong"), pick("w1", "w2").alias("c1"), pick("w2", "w1").alias("c2"))


_S = f"(select t, w1, case when answer = 2 then d_ac else d_ab end as r, case when answer = 2 then d_ab else d_ac end as w, case when answer = 2 then w2 else w1 end as c1, case when answer = 2 then w1 else w2 end as c2 from {_D})"


@register(f"select round(sum(-c1 * ln(p) - c2 * ln(1 - p)) + {LAMBDA * 3}, 4) as objective from (select *, greatest(least(1 / (1 + exp(r - w)), 1 - 1e-6), 1e-6) as p from {_S})")
def map_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative log likelihood of the answers, both confidences counted, and an L1 penalty on the weights."""
    p = score.sigmoid(F.col("wrong") - F.col("right"))
    cost = F.sum(-F.col("c1") * F.log(p) - F.col("c2") * F.log(1 - p))
    return _swapped(distances(spark, sf_dir)).agg(F.round(cost + LAMBDA * sum(WEIGHTS.values()), 4).alias("objective"))


@register(f"select round(sum(w1 * greatest(0, 1 + r - w)) + {LAMBDA * 3}, 4) as objective, sum(case when round(1 + r - w, 9) >= 0 then 1 else 0 end)::bigint as active from {_S}")
def lmnn_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hinge loss with a margin of one; the first confidence weighs, as it was given."""
    hinge = 1 + F.col("right") - F.col("wrong")
    return _swapped(distances(spark, sf_dir)).agg(F.round(F.sum(F.col("w1") * F.greatest(F.lit(0.0), hinge)) + LAMBDA * sum(WEIGHTS.values()), 4).alias("objective"), F.sum(F.when(F.round(hinge, 9) >= 0, 1).otherwise(0)).alias("active"))


_TRAIN, _TEST = f"(select * from {_T} where t % 10 <> 0)", f"(select * from {_T} where t % 10 = 0)"
_PAIRS = f"(select least(a, b) as u, greatest(a, b) as v from {_TEST} union select least(a, c), greatest(a, c) from {_TEST})"


@register(f"""select t, a, b, c from {_TRAIN} x where not exists (select 1 from {_PAIRS} p where p.u = least(x.a, x.b) and p.v = greatest(x.a, x.b))
 and not exists (select 1 from {_PAIRS} p where p.u = least(x.a, x.c) and p.v = greatest(x.a, x.c))""")
def train_test_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of ten folds is for testing; training triplets that share a pair with it are dropped."""
    t = triplets(spark, sf_dir)
    return sets.separated(t.where("t % 10 <> 0"), t.where("t % 10 = 0")).select("t", "a", "b", "c")


@register(f"""select round(sum(case when answer = 2 then (p - 1) * c1 + p * c2 else (p - 1) * c1 + p * c2 end * gp), 4) as g_price, round(sum(((p - 1) * c1 + p * c2) * gs), 4) as g_size from (
 select answer, c1, c2, greatest(least(1 / (1 + exp(r - w)), 1 - 1e-6), 1e-6) as p, gp, gs from {_S} join (
  select t.t as t2, answer, (abs(x.price - z.price) - abs(x.price - y.price)) * case when answer = 2 then -1 else 1 end as gp, (abs(x.size - z.size) - abs(x.size - y.size)) * case when answer = 2 then -1 else 1 end as gs
  from {_T} t join {_F} x on x.p = t.a join {_F} y on y.p = t.b join {_F} z on z.p = t.c) on t = t2)""")
def map_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data term's derivative by each weight."""
    f = features(spark, sf_dir)
    t = triplets(spark, sf_dir)
    for k in "abc":
        t = t.join(f.select(F.col("p").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in WEIGHTS]), k)
    sign = F.when(F.col("answer") == 2, -1.0).otherwise(1.0)
    gap = {c: sign * (F.abs(F.col(f"{c}_a") - F.col(f"{c}_c")) - F.abs(F.col(f"{c}_a") - F.col(f"{c}_b"))) for c in WEIGHTS}
    p = score.sigmoid(sum((w * gap[c] for c, w in WEIGHTS.items()), F.lit(0.0)))
    c1, c2 = F.when(F.col("answer") == 2, F.col("w2")).otherwise(F.col("w1")), F.when(F.col("answer") == 2, F.col("w1")).otherwise(F.col("w2"))
    return t.agg(*[F.round(F.sum(((p - 1) * c1 + p * c2) * g), 4).alias(f"g_{c}") for c, g in gap.items()])
