"""Queries on pairs, roles, complements and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelab.operators import sets
from shapelab.session import table

from .registry import register


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order, its smallest and its largest part."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("first"), F.max("l_partkey").alias("last"))


_ENDS = "(select l_orderkey, min(l_partkey) as first, max(l_partkey) as last from lineitem group by 1)"


@register(f"select distinct least(first, last) as u, greatest(first, last) as v from {_ENDS} where first <> last")
def canonical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.canonical_pairs(ends(spark, sf_dir), "first", "last")


@register(f"select src, count(*) as n, sum(dst)::bigint as s from (select first as src, last as dst from {_ENDS} union all select last, first from {_ENDS}) group by 1")
def both_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.both_directions(ends(spark, sf_dir), "first", "last").groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("dst").alias("s"))


@register("""select role, count(*) as n, sum(l_quantity) as q from (select l_linestatus as role, l_quantity from lineitem where l_returnflag = 'A'
 union all select l_returnflag, l_quantity from lineitem where l_returnflag = 'R') group by 1""")
def union_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    u = sets.union_roles(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), "l_linestatus", "l_returnflag")
    return u.groupBy(F.col("l_linestatus").alias("role")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@register("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P' and o_custkey is not null)")
def complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return sets.complement(table(spark, sf_dir, "customer").select("c_custkey"), taken, ["c_custkey"])


@register("""select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P' and o_custkey is not null)
 intersect select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F' and o_custkey is not null)""")
def intersect_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    left = [sets.complement(c, o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]) for s in "PF"]
    return left[0].intersect(left[1])


@register("select l_orderkey, count(*) as n, sum(case when p_size >= 25 then 1 else 0 end)::bigint as n_hit from lineitem join part on p_partkey = l_partkey group by 1 having sum(case when p_size >= 25 then 1 else 0 end) >= 0.5 * count(*)")
def coverage_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of whose lines at least half meet a large part."""
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return sets.covered(m, ["l_orderkey"], F.col("p_size") >= 25, 0.5)


@register("""select p_partkey, s_suppkey from (select distinct p_partkey, s_suppkey from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
 where greatest(p_retailprice, s_acctbal) / least(p_retailprice, s_acctbal) <= 5 and least(p_retailprice, s_acctbal) > 0)""")
def ratio_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked parts and suppliers whose sizes differ by no more than five times."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    p, s = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    lo, hi = F.least("p_retailprice", "s_acctbal"), F.greatest("p_retailprice", "s_acctbal")
    return j.where(lo > 0).where(hi / lo <= 5).select("p_partkey", "s_suppkey")
