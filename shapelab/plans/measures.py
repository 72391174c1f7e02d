"""Queries on quantiles, histograms, running sums and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapelab.functions import hist, rank, score
from shapelab.session import cut, table

from .registry import register

_HAZEN = """(select {keys}{sep} a + (h - floor(h)) * (b - a) as q from (
 select {keys}{sep} max(h) as h, max(case when rn = floor(h) then v end) as a, max(case when rn = ceil(h) then v end) as b from (
  select {keys}{sep} {v} as v, row_number() over ({part} order by {v}) as rn,
   greatest(least(count(*) over ({part}) * {p} + 0.5, count(*) over ({part})), 1) as h from {t} where {v} is not null) {group}))"""


def hazen_sql(t: str, v: str, p: float, keys: str = "") -> str:
    return _HAZEN.format(t=t, v=v, p=p, keys=keys, sep="," if keys else "", part=f"partition by {keys}" if keys else "", group=f"group by {keys}" if keys else "")


@register(f"select l_returnflag, round(q, 6) as q90 from {hazen_sql('lineitem', 'l_extendedprice', 0.9, 'l_returnflag')}")
def hazen_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.hazen(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.9).select("l_returnflag", F.round("q", 6).alias("q90"))


@register("""select l_returnflag, l_linestatus, v as q30 from (select l_returnflag, l_linestatus, l_extendedprice as v,
 row_number() over (partition by l_returnflag, l_linestatus order by l_extendedprice) - 1 as r, count(*) over (partition by l_returnflag, l_linestatus) as n from lineitem)
 where r = floor(n * 0.3)""")
def nth_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.nth_quantile(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.3, "q30")


@register("""select o_orderpriority, v as median from (select o_orderpriority, o_totalprice as v, row_number() over (partition by o_orderpriority order by o_totalprice) - 1 as r,
 count(*) over (partition by o_orderpriority) as n from orders) where r = floor(n * 0.5)""")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.upper_median(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")


@register(f"""select l.l_returnflag, l_linestatus, count(*) as n, sum(case when l_quantity >= q then 1 else 0 end)::bigint as clamped, round(avg(least(l_quantity / case when q = 0 then 1 else q end, 1)), 6) as mean_scaled
 from lineitem l join {hazen_sql('lineitem', 'l_quantity', 0.9, 'l_returnflag')} s on l.l_returnflag = s.l_returnflag group by 1, 2""")
def scale_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    s = rank.hazen(li, ["l_returnflag"], "l_quantity", 0.9)
    x = score.scaled(F.col("l_quantity"), F.col("q"))
    return li.join(s, "l_returnflag").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("l_quantity") >= F.col("q"), 1).otherwise(0)).alias("clamped"), F.round(F.avg(x), 6).alias("mean_scaled"))


_HARD = """select g as l_returnflag, b as bin, coalesce(n, 0) / sum(coalesce(n, 0)) over (partition by g) as p from
 (select distinct l_returnflag as g from lineitem) cross join (select unnest(range(0, 32))::int as b)
 left join (select l_returnflag as g, greatest(0, least(31, floor(l_quantity / 50 * 32)))::int as b, count(*) as n from lineitem group by 1, 2) using (g, b)"""


@register(f"select l_returnflag, bin, round(p, 9) as p from ({_HARD})")
def hist_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hist.histogram(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 32, 0, 50, smooth=False)
    return h.withColumn("p", F.round("p", 9))


def smooth_sql(keys: str, v: str, t: str, bins: int, lo: float, hi: float) -> str:
    return f"""(select {keys}, b as bin, coalesce(w, 0) / sum(coalesce(w, 0)) over (partition by {keys}) as p from
 (select distinct {keys} from {t}) cross join (select unnest(range(0, {bins}))::int as b)
 left join (select {keys}, b, sum(exp(-(pos - b - 0.5) * (pos - b - 0.5) / 8.0)) as w from
  (select {keys}, pos, unnest(range(greatest(0, trunc(pos - 6))::int, least({bins - 1}, trunc(pos + 6))::int + 1))::int as b from
   (select {keys}, ({v} - {lo}) / ({hi} - {lo}) * {bins} as pos from {t})) group by {keys}, b) using ({keys}, b))"""


@register(f"select l_returnflag, bin, round(p, 8) as p from {smooth_sql('l_returnflag', 'l_quantity', 'lineitem', 32, 0.0, 50.0)}")
def hist_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist.histogram(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 32, 0, 50).withColumn("p", F.round("p", 8))


@register(f"""with c as (select l_returnflag as g, bin, sum(p) over (partition by l_returnflag order by bin) as cdf from {smooth_sql('l_returnflag', 'l_extendedprice', 'lineitem', 64, 0.0, 110000.0)})
 select x.g as a, y.g as b, round(sum(abs(x.cdf - y.cdf)), 6) as emd from c x join c y on x.bin = y.bin and x.g < y.g group by 1, 2""")
def emd_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hist.histogram(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 64, 0, 110000)
    return hist.emd(h, "l_returnflag").withColumn("emd", F.round("emd", 6))


_K = "(select l_returnflag, l_linestatus, l_discount * 20 - 1 as k1, l_tax * 25 - 1 as k2 from lineitem)"
_METRICS = "[k1, k2, case when abs(k1) > abs(k2) then k1 else k2 end, case when abs(k1) > abs(k2) then k2 else k1 end, (k1 + k2) / 2, k1 * k2, abs(k1), abs(k2), case when abs(k1) > abs(k2) then abs(k1) else abs(k2) end, case when abs(k1) > abs(k2) then abs(k2) else abs(k1) end, abs(k1 + k2) / 2, abs(k1 * k2), (abs(k1) + abs(k2)) / 2]"


def _curvatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_discount") * 20 - 1).alias("k1"), (F.col("l_tax") * 25 - 1).alias("k2"))


@register("select l_returnflag, l_linestatus, " + ", ".join(f"round(avg(m[{i + 1}]), 6) as {n}" for i, n in enumerate(score.CURVATURE)) + f" from (select l_returnflag, l_linestatus, {_METRICS} as m from {_K}) group by 1, 2")
def curvature_metrics13(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = score.curvature_metrics(F.col("k1"), F.col("k2"))
    return _curvatures(spark, sf_dir).groupBy("l_returnflag", "l_linestatus").agg(*[F.round(F.avg(c), 6).alias(n) for n, c in m.items()])


_SHIFT = "list_transform(m, lambda x, i: case when i <= 6 then (x + 1) / 2 else x end)"


def _curvature_emd_sql(bins: int) -> str:
    rows = f"(select g, metric, v from (select l_returnflag as g, unnest({list(score.CURVATURE)}) as metric, unnest({_SHIFT}) as v from (select l_returnflag, {_METRICS} as m from {_K})))"
    return f"""select x.g as a, y.g as b, x.metric, {bins} as bins, round(sum(abs(x.cdf - y.cdf)), 6) as emd from
 (select g, metric, bin, sum(p) over (partition by g, metric order by bin) as cdf from {smooth_sql('g, metric', 'v', rows, bins, 0.0, 1.0)}) x join
 (select g, metric, bin, sum(p) over (partition by g, metric order by bin) as cdf from {smooth_sql('g, metric', 'v', rows, bins, 0.0, 1.0)}) y on x.bin = y.bin and x.metric = y.metric and x.g < y.g group by 1, 2, 3"""


@register(" union all ".join(_curvature_emd_sql(b) for b in (16, 32, 64, 128)))
def curvature_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = score.curvature_metrics(F.col("k1"), F.col("k2"), unit_range=True)
    pairs = _curvatures(spark, sf_dir).groupBy("l_returnflag", "k1", "k2").agg(F.count(F.lit(1)).alias("c"))
    each = pairs.select("l_returnflag", "c", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("v")) for n, c in m.items()])).alias("x")).select("l_returnflag", "x.metric", "x.v", "c")
    each = cut(each.groupBy("l_returnflag", "metric", "v").agg(F.sum("c").alias("c")))
    out = None
    for bins in (16, 32, 64, 128):
        h = hist.histogram(each, ["l_returnflag", "metric"], "v", bins, weight="c")
        e = hist.emd(h, "l_returnflag", ["metric"]).select("a", "b", "metric", F.lit(bins).alias("bins"), F.round("emd", 6).alias("emd"))
        out = e if out is None else out.unionByName(e)
    return out


@register("""select l_shipmonth, round(avg(t1), 6) as taken, round(avg(greatest(0, -ln(1 - exp(-t1) + 1e-5))), 6) as left_out from
 (select strftime(l_shipdate, '%Y-%m') as l_shipmonth, l_extendedprice / 100000 / 0.5 as t1 from lineitem) group by 1""")
def energy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, left = score.energy_terms(F.col("l_extendedprice") / 100000, 0.5)
    return table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("l_shipmonth")).agg(F.round(F.avg(taken), 6).alias("taken"), F.round(F.avg(left), 6).alias("left_out"))


@register("""select l_returnflag, round(avg(case when hi = lo then 1 else ln((l_extendedprice - lo) / (hi - lo) * 4 + 1) / ln(5) end), 6) as mean_log from lineitem
 join (select l_returnflag, min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem group by 1) using (l_returnflag) group by 1""")
def log_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    ends = li.groupBy("l_returnflag").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    return li.join(ends, "l_returnflag").groupBy("l_returnflag").agg(F.round(F.avg(score.log_normal(F.col("l_extendedprice"), F.col("lo"), F.col("hi"))), 6).alias("mean_log"))


def area_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, lo, hi): each part's share of the summed prices, as a piece of [0, 1)."""
    p = table(spark, sf_dir, "part").groupBy("p_partkey").agg(F.sum("p_retailprice").alias("w"))
    r = rank.running(cut(p), [], "p_partkey", "w")
    return r.select("p_partkey", (F.col("before") / F.col("total")).alias("lo"), ((F.col("before") + F.col("w")) / F.col("total")).alias("hi"))


_CDF = "(select p_partkey, (s - w) / t as lo, s / t as hi from (select p_partkey, p_retailprice as w, sum(p_retailprice) over (order by p_partkey) as s, sum(p_retailprice) over () as t from part))"


@register(f"select p_partkey, round(hi, 9) as cdf from {_CDF}")
def cdf_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return area_cdf(spark, sf_dir).select("p_partkey", F.round("hi", 9).alias("cdf"))


_U = "(s_suppkey * 0.6180339887498949 - floor(s_suppkey * 0.6180339887498949))"


@register(f"select s_suppkey, p_partkey from supplier join {_CDF} on lo <= {_U} and {_U} < hi")
def inverse_cdf_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join as an equi-join on cells of [0, 1): a piece is in every cell that it touches."""
    n = 4096
    pieces = area_cdf(spark, sf_dir).withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * n), F.floor(F.col("hi") * n))))
    x = F.col("s_suppkey") * 0.6180339887498949
    u = table(spark, sf_dir, "supplier").select("s_suppkey", (x - F.floor(x)).alias("u")).withColumn("cell", F.floor(F.col("u") * n))
    return u.join(pieces, "cell").where("lo <= u and u < hi").select("s_suppkey", "p_partkey")


@register("""select l_orderkey, l_partkey, q / sum(q) over (partition by l_orderkey) / m as share from
 (select l_orderkey, l_partkey, sum(l_quantity) as q from lineitem group by 1, 2) join (select l_partkey, greatest(1, count(distinct l_orderkey)) as m from lineitem group by 1) using (l_partkey)""".replace("q / sum(q) over (partition by l_orderkey) / m as share", "round(q / sum(q) over (partition by l_orderkey) / m, 9) as share"))
def saliency_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as shapes, parts as elements: a part's share of its order, divided by the orders that it is in."""
    q = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    m = q.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("m"))
    z = F.sum("q").over(Window.partitionBy("l_orderkey"))
    return q.withColumn("z", z).join(m, "l_partkey").select("l_orderkey", "l_partkey", F.round(F.col("q") / F.col("z") / F.greatest(F.lit(1), "m"), 9).alias("share"))


@register("select m, count(*) as parts from (select p_partkey, greatest(1, count(distinct l_orderkey)) as m from part left join lineitem on p_partkey = l_partkey group by 1) group by 1")
def multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct().groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    p = table(spark, sf_dir, "part").select("p_partkey").join(pairs, F.col("p_partkey") == F.col("l_partkey"), "left")
    return p.groupBy(F.greatest(F.lit(1), F.coalesce("n", F.lit(0))).cast("long").alias("m")).agg(F.count(F.lit(1)).alias("parts"))


@register("select event_type, count(*) as n, round(avg(value), 6) as mean_value from events where event_id % 10 = 0 group by 1")
def stride_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth row by position, the sampling operator itself."""
    return table(spark, sf_dir, "events").where("event_id % 10 = 0").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@register("select source, count(*) as n from documents group by 1 having count(*) >= 20")
def seg_min_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@register("""select doc_id, generate_subscripts(l, 1)::int - 1 as pos, length(unnest(l))::int as len from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)""")
def segments_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return d.select("doc_id", "pos", F.length("line").alias("len"))


@register("""select p_partkey, unnest(range(0, greatest(floor(p_size / 4.0)::int, 1)))::int as step, round(unnest(range(0, greatest(floor(p_size / 4.0)::int, 1))) * 4.0 / p_size, 9) as at from part where p_size > 0""")
def resample_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points at equal distances along a segment of length p_size; a shorter one has its start alone."""
    n = F.greatest(F.floor(F.col("p_size") / 4.0).cast("int"), F.lit(1))
    p = table(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), n - 1)).alias("step"))
    return p.select("p_partkey", "step", F.round(F.col("step") * 4.0 / F.col("p_size"), 9).alias("at"))
