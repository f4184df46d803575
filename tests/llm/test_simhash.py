import random

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from loomspark.llm import graph, simhash
from loomspark.llm.common import materialize


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, linked):
    label = {k: k for k in keys}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    keys = sorted(keys)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {k: root(k) for k in keys}


def signed(v):
    return v - 2**64 if v >= 2**63 else v


@pytest.mark.parametrize("text", [None, "", " \t", "One", "One TWO", "a b c", "A b c d É\x0b\x0cz x\x85y x\xa0y", "w " * 70000, "to be or not to be"])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def near(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


HALVES = [(list(range(0, 64, 2)), 0), (list(range(1, 64, 2)), 1)]


@pytest.mark.parametrize("radius, partitions, paired", [(1, None, 64), (2, None, 64), (2, None, 2), (2, [(list(range(64)), 2)], 64), (2, HALVES, 64), (3, None, 2)])
def test_links_connect_exactly(spark, radius, partitions, paired):
    rng = random.Random(radius)
    values = {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1}
    for v in list(values)[:30]:
        values |= {near(rng, v, b) for b in (1, 2, 3, 4)}
    chain = next(iter(values))
    for _ in range(12):
        chain = near(rng, chain, radius)
        values.add(chain)
    values = sorted(values)
    df = spark.createDataFrame([(signed(v), i) for i, v in enumerate(values)], "fp long, least long")
    close = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= radius
    expected = plain_components([signed(v) for v in values], close)
    edges = materialize(simhash.links(df, radius, paired, partitions))
    assert all(close(e.a, e.b) for e in edges.collect())
    got = {r.node: r.label for r in graph.components(edges).collect()}
    assert {k: got.get(k, k) for k in expected} == expected


def test_dynamic_program_is_optimal():
    rng, from_all = random.Random(0), __import__("itertools").product
    for parts in (1, 2, 3):
        costs = [[0.0, *sorted(rng.random() for _ in range(3))] for _ in range(parts)]
        total = 2 - parts + 1
        least = min(sum(c[t + 1] for c, t in zip(costs, ts, strict=True)) for ts in from_all(range(-1, 3), repeat=parts) if sum(ts) == total)
        cost, chosen = simhash.allocate(costs, total)
        assert sum(chosen) == total and cost == pytest.approx(least)


def test_correlated_bits_share_a_partition():
    import numpy as np

    rng = np.random.default_rng(0)
    twin = rng.integers(0, 2, (500, 32), dtype=np.uint8)
    bits = np.empty((500, 64), np.uint8)
    bits[:, :32], bits[:, 32:] = twin, twin[:, ::-1]
    values = np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)
    groups = simhash.group_bits(values, 2)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert sum((63 - b in g) for g in groups for b in g) >= 60


ROWS = [
    (10, "The quick brown fox jumps over the lazy dog and runs", 0), (4, "the QUICK brown fox jumps over the lazy dog and runs", 0), (4, "something else", 1),
    (7, None, 0), (9, "", 0), (3, "  \n", 0), (None, "nobody", 0), (None, "nobody", 1), (12, "tie", 0), (12, "tie", 0), (8, "long " * 50000, 0),
]


def test_near_duplicates_of_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, tie long").selectExpr("*", "1 AS fp", "2 AS label", "3 AS row", "4 AS least", "5 AS `a.b`")
    prints = [signed(plain_fingerprint(t)) for _, t, _ in ROWS]
    labels = plain_components(set(prints), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    least = {}
    for (doc_id, _, _), fp in zip(ROWS, prints, strict=True):
        ids = [x for x in (least.get(labels[fp]), doc_id) if x is not None]
        least[labels[fp]] = min(ids, default=None)
    expected = [(d, fp, least[labels[fp]]) for (d, _, _), fp in zip(ROWS, prints, strict=True)]
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(4, ROWS[1][1]), (4, "something else"), (3, "  \n"), (None, "nobody"), (12, "tie"), (8, ROWS[-1][1])], key=repr)
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_components_and_lookup_with_a_hot_key(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300) if i % 100 != 50] + [(5, 5), (None, 3), (1000, 999)], "a long, b long")
    rows = {r.node: r.label for r in graph.components(edges).collect()}
    assert rows[299] == 251 and rows[50] == 0 and rows[51] == 51 and rows[1000] == 999
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, F.lit(-1)).alias("k"), "id")
    right = spark.createDataFrame([(-1, "hot"), (0, "zero"), (3, "three")], "k long, v string")
    got = {r.id: r.v for r in graph.lookup(left, right, "k").collect()}
    assert len(got) == 3000 and got[1] == "hot" and got[0] == "zero" and got[3] == "three" and got[6] is None and got[2] is None
