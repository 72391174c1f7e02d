"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelab.session import cut, stored

from .skew import hot_keys, spread_join

#: Labels that are sent to every task, at most; more are joined by key.
SENT = 50_000


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components: (node, component), where the component is its smallest node.

    Every round takes the smallest label among a node's neighbours and then the label of that label
    (pointer jumping), so that long chains shrink by about half a round. Nodes with very many neighbours, and
    labels of very many nodes, are dealt over several tasks (`skew`). Only nodes that changed send their label again.
    Null ends and loops give no edges; an empty table gives no nodes. Rounds are Parquet tables: a checkpoint of so
    few rows would run all tasks of a shuffle twice, and the driver keeps a record of each task.
    """
    e = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null")
    e = stored(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    hubs = hot_keys(e, "b")
    labels = stored(e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")))
    few = labels.count() <= SENT

    def meet(many: DataFrame, one: DataFrame, on: str, hot: DataFrame | None) -> DataFrame:
        return many.join(F.broadcast(one), on) if few else spread_join(many, one, on, hot)

    sent = labels.select(F.col("a").alias("b"), "label")
    while True:
        near = meet(e, sent, "b", hubs).groupBy("a").agg(F.min("label").alias("near"))
        step = stored(labels.join(F.broadcast(near) if few else near, "a", "left").select("a", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("now")))
        jump = step.select(F.col("a").alias("now"), F.col("now").alias("next"))
        after = stored(meet(step, jump, "now", None if few else hot_keys(step, "now")).select("a", "was", F.least("now", "next").alias("label")))
        labels = after.select("a", "label")
        sent = after.where("label <> was").select(F.col("a").alias("b"), "label")
        if sent.isEmpty():
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))


def keep_first(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """The nodes that a scan in ascending order keeps, if it drops each one that is near to one kept before.

    nodes: node. near: a, b, in any direction. In every round the nodes without an undecided smaller neighbour are
    kept, and their larger neighbours dropped, until all are decided; the result is that of the scan."""
    e = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    open_, e, kept = cut(nodes.select("node").distinct()), cut(e), None
    while True:
        waits = e.select(F.col("b").alias("node")).distinct()
        now = cut(open_.join(waits, "node", "left_anti"))
        kept = now if kept is None else kept.unionByName(now)
        dropped = cut(e.join(now, e["a"] == now["node"], "left_semi").select(F.col("b").alias("node")).distinct())
        open_ = cut(open_.join(now, "node", "left_anti").join(dropped, "node", "left_anti"))
        if open_.isEmpty():
            return kept
        left = open_.select("node")
        e = cut(e.join(left.withColumnRenamed("node", "a"), "a", "left_semi").join(left.withColumnRenamed("node", "b"), "b", "left_semi"))
