"""Admission times against a plain fold over each host's events, with hosts in one block and in many."""

import random

import pytest

from loomspark.operators import pacing


def plain(requests, delays, rate, burst):
    out = []
    for host in {r[0] for r in requests}:
        events = sorted([(at, 1, tie) for h, at, tie in requests if h == host and at is not None] + [(at, 0, d) for h, at, d in delays if h == host and d and d > 0], key=lambda e: e[:2] + ((e[2],) if e[1] else (0,)))
        tokens, gap, last = float(burst), 1 / rate, None
        for at, request, x in events:
            tokens = min(burst, tokens + (0 if last is None else at - last) / gap)
            last = at
            if not request:
                gap = max(gap, x)
                continue
            tokens -= 1
            out.append((host, x, round(at + max(0.0, -tokens) * gap, 6)))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 7, 40])
@pytest.mark.parametrize("rate, burst", [(1.0, 3), (0.3, 1), (4.0, 10)])
def test_admissions_equal_a_plain_fold(spark, parts, rate, burst):
    rng = random.Random(parts)
    requests, delays = [], []
    for host, n in (("hot", 900), ("b", 60), ("c", 1), ("quiet", 30)):
        at = 0.0
        for i in range(n):
            at += rng.choice([0, 0, 0, 0.25, 1, 3]) if host != "quiet" else 20
            requests.append((host, at, i))
            if rng.random() < 0.02:
                delays.append((host, at + rng.choice([0, 0.1]), rng.choice([0.5, 1.5, 2.0, -1.0, None, 0.0])))
    requests.append(("c", None, 5))
    rng.shuffle(requests)
    r = spark.createDataFrame(requests, "host string, at double, n int").selectExpr("*", "n AS row", "'x' AS wait")
    d = spark.createDataFrame(delays, "host string, at double, delay double")
    got = sorted((x.host, x.n, round(x.starts, 6)) for x in pacing.admissions(r, d, "n", rate, burst, parts).collect())
    assert got == plain([x for x in requests], delays, rate, burst)


def test_empty_tables_and_bursts_at_one_time(spark):
    d = spark.createDataFrame([], "host string, at double, delay double")
    none = spark.createDataFrame([], "host string, at double, n int")
    assert pacing.admissions(none, d, "n").count() == 0
    at_once = spark.createDataFrame([("h", 0.0, i) for i in range(7)], "host string, at double, n int")
    assert [r.wait for r in pacing.admissions(at_once, d, "n", parts=5).orderBy("n").collect()] == [0, 0, 0, 1, 2, 3, 4]
