"""Rank fusion, source policy, query dedupe and picking what to read next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60
LOW_VALUE = ("tag", "tags", "category", "search", "login", "signup", "account", "cart")


def fuse(lists: DataFrame, preferred: Column | None = None, low_value: Column | None = None, k: int = K) -> DataFrame:
    """url, score, lists, best_rank from (list_id, rank, url): the sum of 1 / (k + rank) over lists.

    A url counts once in each list, at its first place. Preferred urls count double, low-value ones half.
    """
    first = lists.groupBy("list_id", "url").agg(F.min("rank").alias("rank"))
    fused = first.groupBy("url").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"), F.count("*").alias("lists"), F.min("rank").alias("best_rank"))
    factor = F.lit(1.0)
    if preferred is not None:
        factor = factor * F.when(preferred, 2.0).otherwise(1.0)
    if low_value is not None:
        factor = factor * F.when(low_value, 0.5).otherwise(1.0)
    return fused.withColumn("score", F.round(F.col("score") * factor, 10))


def order(fused: DataFrame) -> DataFrame:
    return fused.orderBy(F.desc("score"), "best_rank", "url")


def query_key(query: Column) -> Column:
    """Lower-case terms without punctuation at their ends (but for + and #), sorted; '' if none is left."""
    terms = F.transform(F.split(F.lower(query), r"(?U)\s+"), lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}+#]+|[^\p{L}\p{N}+#]+$", ""))
    return F.array_join(F.array_sort(F.filter(terms, lambda t: t != "")), " ")


def dedupe_queries(candidates: DataFrame, issued: DataFrame | None, query: str, by: list[str], order_by: list[str]) -> DataFrame:
    """Candidates whose terms were neither issued nor seen in an earlier candidate; text and order stay."""
    keyed = candidates.withColumn("query_key", query_key(F.col(query))).where("query_key <> ''")
    w = Window.partitionBy(*by, "query_key").orderBy(*order_by)
    fresh = keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    if issued is not None:
        done = issued.select(*by, query_key(F.col(query)).alias("query_key")).distinct()
        fresh = fresh.join(done, [*by, "query_key"], "left_anti")
    return fresh


def pick(hits: DataFrame, visited: DataFrame, by: list[str], n: int = 3) -> DataFrame:
    """The first n hits of each search that have not been visited."""
    left = hits.join(visited.select("url").distinct(), "url", "left_anti")
    w = Window.partitionBy(*by).orderBy("rank", "url")
    return left.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)
