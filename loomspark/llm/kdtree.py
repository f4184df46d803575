"""Exact top-k inner product search with a KD-tree for each shard.

Vectors are dealt into shards of bounded size. A shard's task builds a tree by median splits of the
widest side, with a tight bounding box for every node, and answers blocks of queries: nodes are taken
best first by the largest inner product that any point of their box can have with the query, and a
query stops when that bound is below its kth best score.

The kth score is propagated: a first round searches one shard for each query, and its kth score goes
with the query to all other shards, which return only what can still enter the result. Each shard returns
k rows for a query at most, so what is merged does not grow with the shards' size. The vectors are written with their
shard and shuffled once in each of the two rounds; queries are stated beforehand, and every query
block meets every shard, as an exact search must. A task holds one shard and one batch of queries.

How many leaves the bounds leave out depends on the vectors (KDTree.visited counts them): most on vectors of few effective
dimensions, hardly any where all directions are alike, as no exact bound on a box helps there.

Scores are integer inner products of floor(scale * x), added in 64-bit integers where they cannot
overflow, else in Python's integers and cut to the range of a long. Defined results: vectors that are
null, empty or hold null or non-finite components take no part; vectors are compared within their number of
dimensions; every query row is answered, and only the row itself is left out: other rows with its vec_id are candidates like
any other, and of several query rows with one vec_id each has its own ranks; ties go to the smaller vec_id; rows with a
null vec_id take no part; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 1024
K = 10
LEAF = 256
#: A shard has so many bytes of coordinates at most, and no fewer rows than SHARD_LEAST for the sake of more tasks.
SHARD_BYTES = 1 << 25
SHARD_LEAST = 8192
_SAFE = float(2**52)
_LONG = 2**63 - 1


def scaled(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as whole float64 numbers."""
    return np.floor(vectors.astype(np.float64) * scale)


class KDTree:
    """Nodes in arrays: low and high corners, children, and each leaf's rows, which lie together."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.visited = 0  # leaves, over all searches
        self.low, self.high, self.children, self.span = [], [], [], []
        waiting = [(0, len(ids), -1, 0)]
        while waiting:
            a, b, parent, side = waiting.pop()
            own = points[order[a:b]]
            node = len(self.span)
            low, high = own.min(axis=0), own.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.children.append([-1, -1])
            self.span.append((a, b))
            if parent >= 0:
                self.children[parent][side] = node
            widest = int(np.argmax(high - low))
            if b - a > leaf and high[widest] > low[widest]:
                middle = (a + b) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, widest], middle - a)]
                waiting += [(a, middle, node, 0), (middle, b, node, 1)]
        self.rows, self.ids, self.points = rows[order], ids[order], points[order]
        self.leaves = sum(left < 0 for left, _ in self.children)
        self.low, self.high = np.array(self.low), np.array(self.high)
        largest = np.abs(points).max(initial=0)
        self.exact = largest**2 * points.shape[1] < _SAFE
        self.largest = largest

    def search(self, query: np.ndarray, own: int, k: int, least: float) -> list[tuple[int, int]]:
        """The k best (score, vec_id) with scores of at least `least`, best first, without the row `own`."""
        exact = self.exact and self.largest * np.abs(query).max(initial=0) * len(query) < _SAFE
        # A node's bound: each side's better corner. Outside the exact range it is only used with a margin.
        bounds = np.maximum(self.low * query, self.high * query).sum(axis=1)
        if not exact:
            bounds = bounds + np.abs(bounds) * 1e-9 + 1
        kept: list[tuple[int, int]] = []  # a heap of (score, -vec_id), the worst first
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < least or len(kept) == k and -bound < kept[0][0]:
                break
            left, right = self.children[node]
            if left >= 0:
                heapq.heappush(heap, (-bounds[left], left))
                heapq.heappush(heap, (-bounds[right], right))
                continue
            a, b = self.span[node]
            self.visited += 1
            if exact:
                scores = self.points[a:b] @ query
                floor = max(least, kept[0][0]) if len(kept) == k else least
                good = np.flatnonzero(scores >= floor)
                if len(good) > k:
                    # Keep what is above the kth and all ties with it.
                    good = good[scores[good] >= np.partition(scores[good], -k - 1)[-k - 1]]
                found = zip(scores[good].astype(np.int64).tolist(), self.ids[a:b][good].tolist(), self.rows[a:b][good].tolist(), strict=True)
            else:
                whole = [int(x) for x in query]
                found = [(max(-_LONG - 1, min(_LONG, sum(int(x) * q for x, q in zip(p, whole, strict=True)))), int(i), int(r)) for p, i, r in zip(self.points[a:b], self.ids[a:b], self.rows[a:b], strict=True)]
            for score, vec_id, row in found:
                if row != own and score >= least:
                    if len(kept) < k:
                        heapq.heappush(kept, (score, -vec_id))
                    elif (score, -vec_id) > kept[0]:
                        heapq.heapreplace(kept, (score, -vec_id))
        return [(score, -vec_id) for score, vec_id in sorted(kept, reverse=True)]


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, vector (doubles) and dims of the rows that take part."""
    doubles = F.col("embedding").cast("array<double>").alias("vector")
    df = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), doubles).where("vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(~bad).withColumn("dims", F.size("vector"))


RESULT = "query_row long, query_id long, dims int, vec_id long, score long"


def _searcher(k: int, scale: int, leaf: int):
    """Rows of a shard come first (kind 0), then its queries (kind 1, with the least score to beat)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shard = None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            return *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id")), scaled(flat.reshape(batch.num_rows, -1), scale)

        for whole in batches:
            at = 0
            marks = list(zip(whole.column("dims").to_pylist(), whole.column("shard").to_pylist(), whole.column("kind").to_pylist(), strict=True))
            while at < len(marks):  # stretches of one shard and kind
                end = at
                while end < len(marks) and marks[end] == marks[at]:
                    end += 1
                batch, (dims, number, kind) = whole.slice(at, end - at), marks[at]
                at = end
                if (dims, number) != shard:
                    shard, tree, held = (dims, number), None, []
                own = rows_of(batch)
                if kind == 0:
                    held.append(own)
                    continue
                if not held and tree is None:
                    continue
                if tree is None:
                    tree, held = KDTree(*(np.concatenate(c) for c in zip(*held, strict=True)), leaf), []
                out: list[tuple[int, int, int, int, int]] = []
                for row, query_id, query, least in zip(own[0].tolist(), own[1].tolist(), own[2], batch.column("least").to_pylist(), strict=True):
                    out += [(row, query_id, dims, vec_id, score) for score, vec_id in tree.search(query, row, k, -np.inf if least is None else least)]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_row", "query_id", "dims", "vec_id", "score"])

    return search


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, shard_rows: int | None = None, leaf: int = LEAF) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k best among all other rows."""
    rows = usable(vectors, scale)
    n, widest = rows.agg(F.count("*"), F.max("dims")).first()
    if shard_rows is None:
        cores = vectors.sparkSession.sparkContext.defaultParallelism
        shard_rows = min(max(1, SHARD_BYTES // (8 * (widest or 1))), max(SHARD_LEAST, -(-n // cores)))
    shards = max(1, -(-n // shard_rows))
    # Rows have a number from here on; the table is written, so that it stays.
    numbered = rows.withColumns({"shard": F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int"), "row": F.monotonically_increasing_id()})
    sharded = materialize(numbered)
    queries = sharded.where(is_query).withColumnRenamed("shard", "home")
    empty = F.lit(None).cast("double")

    def searched(asked: DataFrame) -> DataFrame:
        both = sharded.withColumns({"kind": F.lit(0), "least": empty}).unionByName(asked.withColumn("kind", F.lit(1)))
        dealt = both.repartition(shards, "dims", "shard").sortWithinPartitions("dims", "shard", "kind")
        return dealt.mapInArrow(_searcher(k, scale, leaf), RESULT)

    seeds = queries.select("row", "vec_id", "vector", "dims", F.col("home").alias("shard"), empty.alias("least"))
    first = materialize(searched(seeds))
    if shards == 1:
        return _best(first, k)
    kth = first.groupBy(F.col("query_row").alias("row")).agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    kth = kth.select("row", F.when(F.col("n") >= k, F.col("worst")).cast("double").alias("least"))
    asked = queries.join(kth, "row", "left")
    other = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))
    asked = asked.select("row", "vec_id", "vector", "dims", F.explode(other).alias("shard"), "least")
    return _best(first.unionByName(searched(asked)), k)
