"""Iterative operators over the points of the embeddings; checked by tests, as SQL has no loops of this kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelab.operators import cluster, spatial
from shapelab.session import cut, stored

from .geometry import points, vectors
from .registry import register

GRAPH, LIMIT, BANDWIDTH = 0.05, 0.3, 0.15


@register()
def kmeans_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = cut(vectors(spark, sf_dir).select("id", "v"))
    return cluster.kmeans(v, 10)[0].select("id", "cluster", F.round("d", 6).alias("d"))


@register()
def meanshift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point's mode; modes within a hundredth of the bandwidth are one, under the smallest id."""
    p = cut(points(spark, sf_dir).select("id", "x", "y", "z", F.lit(1.0).alias("w")))
    modes = cluster.merged_modes(cluster.mean_shift(p, BANDWIDTH), BANDWIDTH / 100)
    return modes.select("id", "mode", *[F.round(c, 4).alias(c) for c in "xyz"])


@register()
def icp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The even ids are one shape, the odd ones another, to which it is aligned. Returns the moved points."""
    p = points(spark, sf_dir).select("id", "x", "y", "z")
    source = p.where("id % 2 = 0")
    t = cluster.affine_icp(source, p.where("id % 2 = 1"), 0.1)
    return source.select("id", *[F.round(float(t[i, 0]) * F.col("x") + float(t[i, 1]) * F.col("y") + float(t[i, 2]) * F.col("z") + float(t[i, 3]), 6).alias(c) for i, c in enumerate("xyz")])


@register()
def geodesic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean length of the shortest paths from each point over the radius graph, and as a part of the largest mean."""
    p = stored(points(spark, sf_dir))
    if p.groupBy("id").count().where("count > 1").isEmpty():
        m = stored(cluster.path_means(p, p, GRAPH, LIMIT))
    else:  # an id at several places is one node, so that a path goes on from any of them
        e = stored(spatial.radius_join(p, p.withColumnRenamed("id", "query"), GRAPH).where("query <> id").select(F.col("query").alias("src"), F.col("id").alias("dst"), F.col("d").alias("weight")))
        d = cluster.shortest_paths(e, p.select(F.col("id").alias("node")), LIMIT)
        m = stored(d.groupBy("source").agg(F.count(F.lit(1)).alias("reached"), F.avg("d").alias("mean")))
    most = m.agg(F.max("mean")).first()[0] or 1.0
    return m.select("source", "reached", F.round("mean", 6).alias("mean_d"), F.round(F.col("mean") / F.lit(most), 6).alias("centrality"))
