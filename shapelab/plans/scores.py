"""Queries that score points, pairs and shapes: saliency values, weighted distances, orientations, pairs worth a match.

Points are those of `descriptors`, a label is a shape; later dimensions of an embedding stand for features that were
computed before."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelab.functions import score
from shapelab.session import cut, table

from .descriptors import _O, oriented
from .geometry import _V, vectors
from .matching import shape_intrinsics
from .registry import register, registered_sql

#: Values of a point: two of its place, two features, thirteen of curvature, nine of distinctness.
VALUES = 26
_CLAMP = "least(greatest(v[{i}], -1), 1)"
_K = ["k1", "k2", "case when abs(k1) > abs(k2) then k1 else k2 end", "case when abs(k1) > abs(k2) then k2 else k1 end", "(k1 + k2) / 2", "k1 * k2"]
_K13 = [*_K, *[f"abs({k})" for k in _K], "(abs(k1) + abs(k2)) / 2"]


@register(f"""with p as (select id, label, v, v[1] as x, v[2] as y, v[3] as z, {_CLAMP.format(i=10)} as k1, {_CLAMP.format(i=11)} as k2 from {_V}),
 b as (select label, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(z) as z0, max(z) as z1 from p group by 1),
 j as (select p.*, case when y1 = y0 then 0 else (y - y0) / (y1 - y0) end as h, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) + (z1 - z0) * (z1 - z0) as s,
 (2 * x - x0 - x1) * (2 * x - x0 - x1) + (2 * y - y0 - y1) * (2 * y - y0 - y1) + (2 * z - z0 - z1) * (2 * z - z0 - z1) as r from p join b using (label))
 select id, k::int as k, round(a[k + 1], 6) as s from (select id, [h, case when s = 0 then 0 else r / s end, abs(v[8]), abs(v[9]), {", ".join(_K13)}, {", ".join(f"abs(v[{i}])" for i in range(12, 21))}]::double[] as a from j), range({VALUES}) t(k)""")
def point_saliency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 26 values of every point, a row each: height and distance from the middle of its shape's box, two features,
    curvature, distinctness. A box without height or size gives 0."""
    v = F.col("v")
    p = vectors(spark, sf_dir).select("id", "label", "v", *[v[i].alias(c) for i, c in enumerate("xyz")])
    box = p.groupBy("label").agg(*[f(c).alias(f"{c}{i}") for c in "xyz" for i, f in enumerate((F.min, F.max))])
    j = p.join(box, "label")
    total = lambda of: sum((of(c) * of(c) for c in "xyz"), F.lit(0.0))
    span = total(lambda c: F.col(f"{c}1") - F.col(f"{c}0"))
    off = total(lambda c: 2 * F.col(c) - F.col(f"{c}0") - F.col(f"{c}1"))
    high = F.col("y1") - F.col("y0")
    k1, k2 = (F.least(F.greatest(v[i], F.lit(-1.0)), F.lit(1.0)) for i in (9, 10))
    place = [F.when(high == 0, 0.0).otherwise((F.col("y") - F.col("y0")) / high), F.when(span == 0, 0.0).otherwise(off / span)]
    s = F.array(*place, *[F.abs(v[i]) for i in (7, 8)], *score.curvature_metrics(k1, k2).values(), *[F.abs(v[i]) for i in range(11, 20)])
    return j.select("id", F.posexplode(s).alias("k", "s")).select("id", "k", F.round("s", 6).alias("s"))


# Scales, weights and the constant of the scores: stand-ins, in the order of the distances.
SCALES, WEIGHTS, CONSTANT = (40.0, 60000.0, 0.08, 0.06), (0.4, 0.3, 0.2, 0.1), -0.5
_DISTANCES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_SIMPLE = " + ".join(f"{c} / {s} * {w}" for c, s, w in zip(_DISTANCES, SCALES, WEIGHTS))
_FULL = " + ".join(f"least({c} / {s}, 1) * {w}" for c, s, w in zip(_DISTANCES, SCALES, WEIGHTS))


@register(f"select l_orderkey as pair, l_linenumber as element, {_SIMPLE} as simple, {_FULL} as full_score, round(1 / (1 + exp(-({_FULL} + {CONSTANT}))), 6) as saliency from lineitem")
def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted distances in units of their scales, as they are and at most 1 each, and the latter's sigmoid."""
    parts = [(F.col(c) / s, w) for c, s, w in zip(_DISTANCES, SCALES, WEIGHTS)]
    simple = sum((x * w for x, w in parts[1:]), parts[0][0] * parts[0][1])
    full = sum((F.least(x, F.lit(1.0)) * w for x, w in parts[1:]), F.least(parts[0][0], F.lit(1.0)) * parts[0][1])
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("element"), simple.alias("simple"), full.alias("full_score"), F.round(1 / (1 + F.exp(-(full + CONSTANT))), 6).alias("saliency"))


_BOX = f"(select label, (max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) as volume from {_O} group by 1)"
_PARTS = ("linear", "planar", "spherical")


@register(f"""with i as (select * from ({registered_sql('shape_intrinsics')}) join {_BOX} using (label) where volume > 0)
 select a.label as src, b.label as tgt from i a join i b on a.label < b.label where greatest(a.volume / b.volume, b.volume / a.volume) <= 100 and {" and ".join(f"a.{c} > 0 and b.{c} > 0 and greatest(a.{c} / b.{c}, b.{c} / a.{c}) <= 5" for c in _PARTS)}""")
def patch_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of segments whose volumes differ a hundredfold at most and whose linear, planar and spherical parts
    differ fivefold at most. Segments meet by the hundredfold class of their volume and the ones beside it; flat
    segments have no pairs."""
    o = oriented(spark, sf_dir)
    box = o.groupBy("label").agg(*[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).select("label", (F.col("x") * F.col("y") * F.col("z")).alias("volume")).where("volume > 0")
    i = cut(shape_intrinsics(spark, sf_dir).join(box, "label").where(" and ".join(f"{c} > 0" for c in _PARTS)).withColumn("klass", F.floor(F.log(F.col("volume")) / F.log(F.lit(100.0)))))
    a, b = (i.select("klass", *[F.col(c).alias(f"{side}_{c}") for c in ("label", "volume", *_PARTS)]) for side in "ab")
    near = a.withColumn("klass", F.explode(F.array(*[F.col("klass") + k for k in (-1, 0, 1)]))).join(b, "klass").where("a_label < b_label")
    ratio = lambda c: F.greatest(F.col(f"a_{c}") / F.col(f"b_{c}"), F.col(f"b_{c}") / F.col(f"a_{c}"))
    keep = ratio("volume") <= 100
    for c in _PARTS:
        keep = keep & (ratio(c) <= 5)
    return near.where(keep).select(F.col("a_label").alias("src"), F.col("b_label").alias("tgt"))


def principal_axes(points: DataFrame, key: str) -> DataFrame:
    """(key, axes): nine numbers, the principal axes of x, y, z by falling variance, each pointing to the side where
    the box along it, seen from the mean, reaches further. Moments and extents are aggregates; only a group's moments go
    through Python. Equal variances leave the axes' directions open."""
    m = points.groupBy(key).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.covar_pop(a, b).alias(f"{a}{b}") for a in "xyz" for b in "xyz"])

    def axes(parts):  # noqa: ANN001, ANN202
        for g in parts:
            c = g.iloc[:, 4:].to_numpy(float).reshape(-1, 3, 3)
            yield pd.DataFrame({key: g[key], "mean": list(g[["mx", "my", "mz"]].to_numpy(float)), "axes": list(np.linalg.eigh(c)[1][:, :, ::-1].transpose(0, 2, 1).reshape(-1, 9))})

    found = cut(m.mapInPandas(axes, f"{key} {dict(points.dtypes)[key]}, mean array<double>, axes array<double>"))
    along = [sum(((F.col(c) - F.col("mean")[j]) * F.col("axes")[3 * i + j] for j, c in enumerate("xyz")), F.lit(0.0)) for i in range(3)]
    ends = points.join(found, key).groupBy(key).agg(*[(F.max(x) + F.min(x)).alias(f"c{i}") for i, x in enumerate(along)])
    turned = F.array(*[F.when(F.col(f"c{i // 3}") < 0, -F.col("axes")[i]).otherwise(F.col("axes")[i]) for i in range(9)])
    return found.join(ends, key).select(key, turned.alias("axes"))


@register()
def preorientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rotation that turns every shape's points into its own axes."""
    a = principal_axes(oriented(spark, sf_dir).select("label", "x", "y", "z"), "label")
    return a.select("label", *[F.round(F.col("axes")[i], 6).alias(f"r{i // 3}{i % 3}") for i in range(9)])
