import math

import numpy as np
from pyspark.sql import functions as F

from loomspark.llm import kdtree


def brute(rows, k=10):
    usable = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(usable):
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for m, (i, b) in enumerate(usable) if m != n and len(b) == len(a))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def found(df, **how):
    return sorted(tuple(r) for r in kdtree.top_k(df, F.col("vec_id") % 100 == 0, **how).collect())


def test_exact_in_one_shard_and_many(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(600)]
    rows += [(i, [0.5] * 8) for i in range(600, 900)]  # ties and copies
    rows += [(None, [1.0] * 8), (1000, None), (1001, [float("nan")] * 8), (1002, [1.0, None] * 4), (1100, [float("inf")] * 8), (1200, []), (1300, [1.0, 2.0]), (1301, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS shard", "2 AS dims", "3 AS kind", "4 AS rank")
    expected = brute(rows)
    assert found(df) == expected
    assert found(df, shard_rows=100, leaf=8) == expected


def test_few_rows_empty_and_huge(spark):
    schema = "vec_id long, embedding array<double>"
    assert found(spark.createDataFrame([], schema)) == []
    assert found(spark.createDataFrame([(100, [1.0])], schema)) == []
    assert found(spark.createDataFrame([(100, [1.0]), (7, [-2.5])], schema)) == [(100, 1, 7, 1024 * -2560)]
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0])], schema)
    assert found(huge) == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 0), (0, 3, 2, -(2**63))]


def test_repeated_rows_and_ids(spark):
    """Every query row is answered; other rows with its vec_id are candidates, equal ones too."""
    rows = [(100, [1.0, 2.0]), (100, [3.0, -1.0]), (100, [1.0, 2.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [0.0, 5.0])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for how in ({}, {"shard_rows": 4, "leaf": 2}, {"k": 2}):
        assert found(df, **how) == brute(rows, how.get("k", 10))


def test_leaves_visited():
    """Bounds leave most leaves out where vectors lie in groups or have few dimensions; the answers are exact anyway."""
    rng = np.random.default_rng(1)
    flat = np.floor(rng.normal(size=(20000, 3)) * 1000)
    groups = np.floor((rng.normal(size=(40, 64)) * 3)[rng.integers(0, 40, 20000)] * 1000 + rng.normal(size=(20000, 64)) * 100)
    for points, share in ((flat, 0.05), (groups, 0.3)):
        tree = kdtree.KDTree(np.arange(20000), np.arange(20000), points, leaf=32)
        for n in range(0, 20000, 1000):
            scores = points @ points[n]
            best = sorted(((int(-s), i) for i, s in enumerate(scores) if i != n))[:10]
            assert tree.search(points[n], n, 10, -np.inf) == [(-s, i) for s, i in best]
        assert tree.visited < share * 20 * tree.leaves
