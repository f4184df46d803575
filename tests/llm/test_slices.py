"""Bit-sliced sums and top-k against plain numbers, and ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import slices

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=20):
    counts = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, words = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, c, n in counts:
            m = 100 - 25 + (25 * n * n_docs) // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((score, doc_id))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item_id, i + 1, d, s) for i, (s, d) in enumerate(found[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@given(st.lists(st.tuples(st.integers(0, 199), st.integers(1, 2**40)), min_size=1, max_size=60), st.integers(1, 7))
@settings(max_examples=60, deadline=None)
def test_sums_and_top_k_equal_plain_numbers(pairs, k):
    sums, plain = slices.Sums(4), Counter()
    for shift, chunk in enumerate((pairs[::2], pairs[1::2])):
        values = dict(chunk)
        if values:
            places = np.array(sorted(values))
            sums.add(*slices.to_slices(places, np.array([values[p] for p in places])), shift)
            plain.update({p: v << shift for p, v in values.items()})
    want = sorted(((p, v) for p, v in plain.items()), key=lambda x: (-x[1], x[0]))[:k]
    assert sums.top(k) == want
    assert sums.top(k, 2**39) == [x for x in want if x[1] >= 2**39]


def made(seed, n=600):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["The", "ÜBER", "über", "x9", "\u00a0", "日本"]
    frequent = [1 / (i + 1) for i in range(len(words))]
    docs = [(rng.choice([i, i, i, 7, None]), rng.choice([" ", "-", ", "]).join(rng.choices(words, frequent, k=rng.choice([0, 1, 3, 12, 40])))) for i in range(n)]
    docs += [(n, None), (n + 1, "?!"), (n + 2, "w1 " * 30_000), *docs[:50]]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(30)] + [(3, "w1 w1 W1 w1"), (99, None), (98, "nowhere"), (None, "the w2")]
    return docs, items


@pytest.mark.parametrize("dense", [1, 6, 10**9])
@pytest.mark.parametrize("block", [64, 100, 1 << 16])
def test_search_equals_brute_force(spark, monkeypatch, block, dense):
    monkeypatch.setattr(slices, "DENSE", dense)
    docs, items = made(block)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, rank int, row long")
    assert got(slices.search(d, q, block=block)) == brute(docs, items)


def test_groups_of_items_and_small_k(spark, monkeypatch):
    monkeypatch.setattr(slices, "GROUP_ITEMS", 13)
    docs, items = made(5, 90)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(slices.search(d, q, 3)) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = made(6, 20)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(slices.search(d.limit(0), q)) == got(slices.search(d, q.limit(0))) == got(slices.search(d.where("text IS NULL"), q)) == []
