"""Joins on skewed keys, and connected components, without a hot task or a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A key is hot if it holds more than one in so many rows; there can be no more hot keys than that.
HOT_SHARE = 1000


def hot_keys(left: DataFrame, key: str) -> DataFrame:
    """The keys of left with more than one in HOT_SHARE of its rows, so at most HOT_SHARE of them."""
    counts = left.groupBy(key).count()
    return counts.where(F.col("count") * HOT_SHARE > left.count()).select(key)


def lookup(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """left, a written table, with the columns of right, whose key is unique, or nulls; null keys find nothing.

    Rows of hot keys meet their match by a broadcast of at most HOT_SHARE rows; all others are shuffled. Without hot keys it
    is a plain join. hot: the hot_keys() of left, where they are known already.
    """
    columns = [*left.columns, *(c for c in right.columns if c != key)]
    if hot is None:
        hot = hot_keys(left, key)
        if hot.isEmpty():
            return left.join(right, key, "left").select(columns)
    known = right.join(F.broadcast(hot), key).withColumn("_hot", F.lit(True))
    marked = left.join(F.broadcast(known), key, "left")
    added = [c for c in right.columns if c != key]
    cold = marked.where("_hot IS NULL").drop("_hot", *added).join(right, key, "left")
    return marked.where("_hot").select(columns).unionByName(cold.select(columns))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, label), label being the least node that can be reached.

    Nodes take the least label among their neighbours, then the label of that label, until none
    changes; each round is written to the shared folder. Labels are looked up with lookup(), for edges and for labels, so
    neither a component with a large part of all nodes nor a node with a large part of all edges gathers in a task.
    An edge with a null end is ignored.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    hubs = materialize(hot_keys(both, "b"))
    plain = hubs.isEmpty()
    while True:
        named = labels.withColumnRenamed("node", "b")
        near = (both.join(named, "b") if plain else lookup(both, named, "b", hubs)).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        joined = labels.join(near, "node", "left")
        hooked = materialize(joined.select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")))
        further = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = lookup(hooked, further, "label").select("node", F.coalesce("next", "label").alias("label"), "old")
        jumped = materialize(jumped)
        if jumped.where("label <> old").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")
