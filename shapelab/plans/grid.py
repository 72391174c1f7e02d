"""Weights of a wide triplet distance, learned over ten random folds and 3 x 3 x 3 penalties.

A part has four features of its own and, as a stand-in for the features of its elements, the embedding whose id is the
part's key modulo their number: each half of it is a group of weights with a penalty of its own. Folds are ranks by a
hash of the triplet, of sizes at most one apart; what shares a pair of shapes with a fold is no training for it."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapelab.operators.descent import Problem, minimise
from shapelab.operators.skew import hot_keys, spread_join
from shapelab.session import cut, table

from .learning import triplets
from .registry import register
from .training import wide

FOLDS, SLICES = 10, 1024
PENALTIES = (0.001, 0.01, 0.1)
GROUPS = ("own", "low", "high")


def folded(t: DataFrame, folds: int = FOLDS) -> DataFrame:
    """t (dataset, t) with `fold`, 0 to folds - 1, by the rank of a hash within the dataset; no dataset is ordered in one task."""
    t = t.withColumn("_h", F.xxhash64("t", F.lit(11)))
    t = t.withColumn("_slice", F.shiftrightunsigned("_h", 54).cast("int"))  # SLICES of them, in order of the hash
    cells = t.groupBy("dataset", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("dataset").orderBy("_slice")) - F.col("_n")
    cells = cells.withColumn("_before", before).withColumn("_all", F.sum("_n").over(Window.partitionBy("dataset"))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("dataset", "_slice").orderBy("_h", "t")) - 1
    ranked = t.withColumn("_in", inside).join(cells, ["dataset", "_slice"])
    return ranked.withColumn("fold", F.expr(f"(_before + _in) * {folds} div _all").cast("int")).drop("_h", "_slice", "_before", "_all", "_in")


def held(t: DataFrame) -> DataFrame:
    """t (dataset, t, a, b, c, fold) with `held`: the folds that it shares an unordered pair (a, b) or (a, c) with, its own among them."""
    pair = lambda k: F.struct("dataset", F.least("a", k).alias("u"), F.greatest("a", k).alias("v"))
    each = cut(t.select("t", "fold", F.explode(F.array(pair("b"), pair("c"))).alias("pair")))
    of = each.groupBy("pair").agg(F.collect_set("fold").alias("folds"))
    met = spread_join(each.select("t", "pair"), of, "pair", hot_keys(each, "pair"))
    found = met.select("t", F.explode("folds").alias("k")).groupBy("t").agg(F.array_sort(F.collect_set("k")).alias("held"))
    return t.join(found, "t")


def wide_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplets with dataset, fold, held, answer, gap, c1 and c2."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").cast("array<double>").alias("e"))
    many = vectors.count()
    f = wide(spark, sf_dir).withColumn("v", F.pmod("p", F.lit(max(many, 1))))
    f = cut(f.join(vectors, "v").select("p", F.concat("f", "e").alias("f")))
    t = triplets(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("t"), F.col("o_orderstatus").alias("dataset")), "t")
    t = held(cut(folded(t)))
    for k in "abc":
        t = t.join(f.select(F.col("p").alias(k), F.col("f").alias(f"f_{k}")), k)
    two = F.col("answer") == 2
    apart = lambda k: F.zip_with("f_a", f"f_{k}", lambda x, y: F.abs(x - y))
    gap = F.zip_with(apart("c"), apart("b"), lambda c, b: F.when(two, b - c).otherwise(c - b))
    return t.select("t", "dataset", "fold", "held", "answer", gap.alias("gap"), F.when(two, F.col("w2")).otherwise(F.col("w1")).alias("c1"), F.when(two, F.col("w1")).otherwise(F.col("w2")).alias("c2"))


def grid(g: DataFrame, penalties: tuple[float, ...] = PENALTIES, folds: int = FOLDS, own: int = 4) -> list[tuple]:
    """(dataset, fold or -1 for all, the three penalties, weights, objective) of every fit. g: `wide_gaps`, a table."""
    first = g.select(F.size("gap").alias("n")).first()
    if first is None:
        return []
    half = own + (first.n - own) // 2
    group = [0] * own + [1] * (half - own) + [2] * (first.n - half)
    names = sorted(r[0] for r in g.select("dataset").distinct().collect())
    problems = [(d, k, x) for d in names for k in (*range(folds), None) for x in product(penalties, repeat=3)]
    fits = minimise(g, [Problem(d, k, tuple(x[i] for i in group)) for d, k, x in problems], [1.0] * first.n, settle=1e-6)
    return [(d, -1 if k is None else k, *x, [float(y) for y in w], float(v)) for (d, k, x), (w, v) in zip(problems, fits)]


def judged(g: DataFrame, fits: list[tuple]) -> DataFrame:
    """Each triplet under each penalty, judged by the weights of the fold that it is in: right, and by how much. A tie is B."""
    w = g.sparkSession.createDataFrame(fits, "dataset string, fold int, l_own double, l_low double, l_high double, w array<double>, objective double")
    by = F.broadcast(w.where("fold >= 0").groupBy("dataset", "fold").agg(F.collect_list(F.struct("l_own", "l_low", "l_high", "w")).alias("x")))  # a row per fold, 27 fits in each
    each = g.select("t", "dataset", "fold", "answer", "gap").join(by, ["dataset", "fold"]).select("t", "dataset", "fold", "answer", "gap", F.explode("x").alias("x"))
    margin = F.aggregate(F.zip_with("x.w", "gap", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    each = each.select("t", "dataset", "fold", "answer", "x.l_own", "x.l_low", "x.l_high", F.round(margin, 9).alias("margin"))
    return each.withColumn("right", (F.col("margin") > 0) | ((F.col("margin") == 0) & (F.col("answer") == 1)))


def chosen(tested: DataFrame) -> DataFrame:
    """Of each dataset the penalties with the most right answers outside of training (ties: the smaller ones)."""
    best = F.max(F.struct("n_right", *[(-F.col(f"l_{x}")).alias(x) for x in GROUPS])).alias("m")
    return tested.groupBy("dataset").agg(best).select("dataset", *[(-F.col(f"m.{x}")).alias(f"l_{x}") for x in GROUPS])


_KEYS = ["dataset", *[f"l_{x}" for x in GROUPS]]


@register()
def learn_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By dataset and penalties: right answers of all triplets, each outside of training; whether it is the best of its dataset; weights, objective and each group's share of the weights, from a fit to all."""
    g = cut(wide_gaps(spark, sf_dir))
    fits = grid(g)
    tested = cut(judged(g, fits).groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("right").cast("long")).alias("n_right")))
    best = chosen(tested).withColumn("best", F.lit(True))
    w = spark.createDataFrame([(d, *x, v, w, [sum(w[:4]), sum(w[4 : 4 + (len(w) - 4) // 2]), sum(w[4 + (len(w) - 4) // 2 :])]) for d, k, *x, w, v in fits if k < 0], "dataset string, l_own double, l_low double, l_high double, objective double, w array<double>, of array<double>")
    whole = F.aggregate("of", F.lit(0.0), lambda a, x: a + x)
    shares = [F.round(F.when(whole > 0, F.col("of")[i] / whole).otherwise(0.0), 3).alias(f"share_{x}") for i, x in enumerate(GROUPS)]
    out = tested.join(w, _KEYS).join(best, _KEYS, "left")
    return out.select(*_KEYS, "n", "n_right", F.coalesce("best", F.lit(False)).alias("best"), F.round("objective", 2).alias("objective"), *shares, F.transform("w", lambda x: F.round(x, 3)).alias("w"))


@register()
def learn_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each triplet under the best penalties of its dataset: its fold, whether weights learned without that fold answer right, and the margin."""
    g = cut(wide_gaps(spark, sf_dir))
    each = cut(judged(g, grid(g)))
    best = chosen(each.groupBy(*_KEYS).agg(F.sum(F.col("right").cast("long")).alias("n_right")))
    return each.join(F.broadcast(best), _KEYS, "left_semi").select("dataset", "t", "fold", "answer", "right", F.round("margin", 3).alias("margin"))
