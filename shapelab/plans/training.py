"""Queries that learn the weights of the triplet distance, and the distance in full.

A part is a shape, its lines are points; datasets are order states, folds the parity of the order's key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelab.functions import rank, score
from shapelab.operators import sets
from shapelab.operators.fit import fit
from shapelab.session import cut, table

from .learning import _F, _T, features, triplets
from .registry import register

FOLDS, LAMBDAS = ("0", "1", "all"), (0.001, 10.0)
NAMES = ("price", "size", "quantity", "discount")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p, f): the two scaled features of a part and the means of its lines."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p")).agg(F.avg(F.col("l_quantity") / 50).alias("quantity"), F.avg(F.col("l_discount") * 10).alias("discount"))
    return features(spark, sf_dir).join(li, "p").select("p", F.array(*NAMES).alias("f"))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplets with dataset, gap (distance to the wrong answer less that to the right one, by feature), c1 and c2."""
    f, t = cut(wide(spark, sf_dir)), triplets(spark, sf_dir)
    for k in "abc":
        t = t.join(f.select(F.col("p").alias(k), F.col("f").alias(f"f_{k}")), k)
    t = t.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("t"), F.col("o_orderstatus").alias("dataset")), "t")
    two = F.col("answer") == 2
    apart = lambda k: F.zip_with("f_a", f"f_{k}", lambda x, y: F.abs(x - y))
    gap = F.zip_with(apart("c"), apart("b"), lambda c, b: F.when(two, b - c).otherwise(c - b))
    return t.select("t", "a", "b", "c", "dataset", "answer", gap.alias("gap"), F.when(two, F.col("w2")).otherwise(F.col("w1")).alias("c1"), F.when(two, F.col("w1")).otherwise(F.col("w2")).alias("c2"))


def learned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple]]:
    """The triplets, and (dataset, fold, lambda, weights, objective) of every problem."""
    g = cut(gaps(spark, sf_dir))
    parts = []
    for fold in ("0", "1"):
        test = g.where(F.pmod("t", F.lit(2)) == int(fold))
        parts.append(sets.separated(g.where(F.pmod("t", F.lit(2)) != int(fold)), test).select(*g.columns).withColumn("fold", F.lit(fold)))
    rows = parts[0].unionByName(parts[1]).unionByName(g.withColumn("fold", F.lit("all"))).withColumn("lambda", F.explode(F.array(*map(F.lit, LAMBDAS))))
    key = F.concat_ws("|", "dataset", "fold", F.col("lambda").cast("string"))
    rows = cut(rows.select(key.alias("problem"), "gap", "c1", "c2"))
    names = {r[0] for r in rows.select("problem").distinct().collect()}  # datasets x folds x lambdas
    found = fit(rows, {n: float(n.split("|")[2]) for n in names}, len(NAMES))
    return g, sorted((*n.split("|")[:2], float(n.split("|")[2]), [float(x) for x in w], v) for n, (w, v) in found.items())


@register()
def learn_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by dataset, fold and penalty, with the shares of right answers inside and outside the fold (all: none is outside)."""
    g, found = learned(spark, sf_dir)
    w = F.broadcast(spark.createDataFrame(found, "dataset string, fold string, lambda double, w array<double>, objective double"))
    right = F.aggregate(F.zip_with("w", "gap", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    hit = F.when((F.round(right, 9) > 0) | ((F.round(right, 9) == 0) & (F.col("answer") == 1)), 1.0).otherwise(0.0)
    test = F.col("fold") == F.pmod("t", F.lit(2)).cast("string")
    rows = g.join(w, "dataset").groupBy("dataset", "fold", "lambda", "w", "objective").agg(F.avg(F.when(test, hit)).alias("test"), F.avg(F.when(~test, hit)).alias("train"))
    return rows.select("dataset", "fold", "lambda", *[F.round(F.col("w")[i], 4).alias(f"w_{n}") for i, n in enumerate(NAMES)], F.round("objective", 3).alias("objective"), F.round("train", 6).alias("train"), F.round("test", 6).alias("test"))


@register()
def best_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each dataset the penalty with the most right answers outside the folds (ties: the smaller), its weights from all triplets as they are and as shares of their sum."""
    r = cut(learn_map(spark, sf_dir))
    score_ = r.where("fold <> 'all'").groupBy("dataset", "lambda").agg(F.avg("test").alias("test"))
    best = score_.groupBy("dataset").agg(F.max(F.struct("test", (-F.col("lambda")).alias("k"))).alias("m")).select("dataset", (-F.col("m.k")).alias("lambda"), F.round("m.test", 6).alias("accuracy"))
    total = sum((F.col(f"w_{n}") for n in NAMES), F.lit(0.0))
    return r.drop("test", "train", "objective").where("fold = 'all'").drop("fold").join(best, ["dataset", "lambda"]).select("*", *[F.round(F.when(total > 0, F.col(f"w_{n}") / total).otherwise(0.0), 4).alias(f"share_{n}") for n in NAMES])


_GAPS = f"(select abs(x.price - y.price) as price, abs(x.size - y.size) as size from {_T} t join {_F} x on x.p = t.a join {_F} y on y.p = t.b)"


@register(" union all ".join(f"select '{c}' as feature, (case when '{c}' in ('price', 'size') then 1 else 0 end)::double as weight, round(v, 6) as scale from (select {c} as v, row_number() over (order by {c}) - 1 as r, count(*) over () as n from {_GAPS}) where r = floor(n * 0.8)" for c in ("price", "size")))
def first_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before anything is learned the first two weights are one; scales are the quantiles of the distances."""
    f, t = features(spark, sf_dir), triplets(spark, sf_dir)
    for k in "ab":
        t = t.join(f.select(F.col("p").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("price", "size")]), k)
    d = cut(t.select(*[F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")).alias(c) for c in ("price", "size")]))
    each = d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in d.columns])).alias("x")).select("x.*")
    return rank.nth_quantile(each, ["feature"], "v", 0.8, "scale").select("feature", F.lit(1.0).alias("weight"), F.round("scale", 6).alias("scale"))


#: Weights of the full distance: two of features, two of saliency, of what is unmatched, and the two offsets.
W = {"d": (0.8, 0.4), "s": (1.5, -0.7), "u": 0.6, "db": -0.2, "sb": 0.1}
_SIG = "greatest(least(1 / (1 + exp(-({x}))), 1 - 1e-6), 1e-6)"
_KINDS = {"f": "l_returnflag", "s": "l_linestatus"}


def _element_sql() -> str:
    s = _SIG.format(x=f"l_quantity / 50 * {W['s'][0]} + l_discount * 10 * {W['s'][1]} + {W['sb']}")
    d = lambda x, y: _SIG.format(x=f"({x}) * {W['d'][0]} + ({y}) * {W['d'][1]} + {W['db']}")
    return f"""with pt as (select l_partkey as p, l_returnflag as f, l_linestatus as s, {s} as sal, l_extendedprice / 100000 as price, l_tax * 10 as tax from lineitem),
 z as (select p, sum(sal) as z from pt group by 1), cell as (select p, f, s, sum(sal) as sal from pt group by 1, 2, 3),
 el as (select p, 'f' || f as e, avg(price) as price, avg(tax) as tax from pt group by 1, 2 union all select p, 's' || s, avg(price), avg(tax) from pt group by 1, 2),
 pair as (select t, 1 as j, a, b as x from {_T} union all select t, 2, a, c from {_T}),
 m as (select pair.t, pair.j, pair.a, pair.x, u.e, {d('abs(u.price - v.price)', 'abs(u.tax - v.tax)')} as pd from pair join el u on u.p = pair.a join el v on v.p = pair.x and u.e = v.e),
 side as (select t, j, a as p from pair union all select t, j, x from pair),
 pc as (select side.t, side.j, cell.sal / z.z as n, mf.pd as df, ms.pd as ds from side join cell on cell.p = side.p join z on z.p = side.p left join m mf on mf.t = side.t and mf.j = side.j and mf.e = 'f' || cell.f left join m ms on ms.t = side.t and ms.j = side.j and ms.e = 's' || cell.s),
 e as (select t, j, sum(case when df is null and ds is null then {W['u']} * n else n * (coalesce(df, 0) + coalesce(ds, 0)) / ((case when df is null then 0 else 1 end) + (case when ds is null then 0 else 1 end)) end) / 2 as d from pc group by 1, 2)
 select pair.t, pair.j, round(e.d + {d('abs(x.price - y.price)', 'abs(x.size - y.size)')}, 6) as d from pair join e using (t, j) join {_F} x on x.p = pair.a join {_F} y on y.p = pair.x"""


@register(_element_sql())
def element_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of A to B (j = 1) and to C (2) in full.

    A point's saliency is a sigmoid; it is shared by the matched elements that hold the point, and is a part of its
    shape's. A matched element counts with the mean of both sides' saliency; what no element holds counts as unmatched."""
    sig = lambda x, y, w, b: score.sigmoid(x * w[0] + y * w[1] + b)
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), sig(F.col("l_quantity") / 50, F.col("l_discount") * 10, W["s"], W["sb"]).alias("sal"), (F.col("l_extendedprice") / 100000).alias("price"), (F.col("l_tax") * 10).alias("tax"))
    # what the shapes' points give, by cell of points that are in the same elements
    cell = cut(li.groupBy("p", "f", "s").agg(F.sum("sal").alias("sal"), F.sum("price").alias("price"), F.sum("tax").alias("tax"), F.count(F.lit(1)).alias("n")))
    z = cell.groupBy("p").agg(F.sum("sal").alias("z"))
    el = cell.select("p", "price", "tax", "n", F.explode(F.array(F.concat(F.lit("f"), "f"), F.concat(F.lit("s"), "s"))).alias("e"))
    el = cut(el.groupBy("p", "e").agg((F.sum("price") / F.sum("n")).alias("price"), (F.sum("tax") / F.sum("n")).alias("tax")))
    shape = cell.join(z, "p").groupBy("p").agg(F.collect_list(F.struct("f", "s", (F.col("sal") / F.col("z")).alias("n"))).alias("cells"))  # six cells at most
    own = el.groupBy("p").agg(F.map_from_entries(F.collect_list(F.struct("e", F.struct("price", "tax")))).alias("els"))  # five elements at most
    shape = cut(shape.join(own, "p").join(features(spark, sf_dir), "p"))
    t = triplets(spark, sf_dir)
    pair = t.select("t", "a", F.explode(F.array(F.struct(F.lit(1).alias("j"), F.col("b").alias("x")), F.struct(F.lit(2).alias("j"), F.col("c").alias("x")))).alias("o")).select("t", "a", "o.j", "o.x")
    for k in "ax":
        pair = pair.join(shape.select(F.col("p").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("cells", "els", "price", "size")]), k)

    patch = lambda _, a, x: F.when(a.isNotNull() & x.isNotNull(), sig(F.abs(a["price"] - x["price"]), F.abs(a["tax"] - x["tax"]), W["d"], W["db"]))
    pair = pair.withColumn("m", F.map_zip_with("els_a", "els_x", patch))

    def part(c):  # noqa: ANN001, ANN202
        df, ds = F.col("m")[F.concat(F.lit("f"), c["f"])], F.col("m")[F.concat(F.lit("s"), c["s"])]
        many = df.isNotNull().cast("int") + ds.isNotNull().cast("int")
        return c["n"] * F.when(many > 0, (F.coalesce(df, F.lit(0.0)) + F.coalesce(ds, F.lit(0.0))) / many).otherwise(W["u"])

    inner = F.aggregate(F.concat("cells_a", "cells_x"), F.lit(0.0), lambda acc, c: acc + part(c)) / 2
    whole = sig(F.abs(F.col("price_a") - F.col("price_x")), F.abs(F.col("size_a") - F.col("size_x")), W["d"], W["db"])
    return pair.select("t", "j", F.round(inner + whole, 6).alias("d"))
