import pickle
import random
import zlib
from math import log, sqrt

import numpy as np
import pytest

from loomspark.llm import toxicity


def corpus(n=600, seed=0):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    bad = ["vilorm", "grudzok", "snaff"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            words += [rng.choice(bad) + rng.choice(["", "ed", "ing", "!!", "&&&"]) for _ in range(3)]
            rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    extra = [(None, "grudzok vilorm snaffing"), (700, None), (701, ""), (702, "GRUDZOKED Vilorm " * 20000), (3, "vilorm vilorm snaff"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").selectExpr("*", "'x' AS lang", "1 AS toxic", "2 AS features", "3 AS score")
    marked = spark.createDataFrame(labels + [(1, None), (1, 0), (None, 1)], "doc_id long, toxic int").selectExpr("*", "1 AS quality", "'x' AS text")
    got = toxicity.toxicity(docs, marked).collect()
    assert len(got) == len(rows) + len(extra)
    truth = dict(labels)
    tested = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.97
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    assert by[None][0].predicted == 1 and by[702][0].predicted == 1 and by[700][0].predicted == by[701][0].predicted == 0
    assert sum(r.predicted for r in by[3]) == 1
    assert by[702][0].nearest % 5 == 0 and by[702][0].words and by[702][0].cosine > 0.5


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.toxicity(docs, labels).collect()] == [(0.0, 0)] * 2
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, spark.createDataFrame([(1, 0), (5, 0)], "doc_id long, toxic int")).collect()} == {0}


def plain_cosines(index, ids, weights):
    """(cosine, entry) of all entries, nearest first, ties to the smaller entry."""
    out = []
    for n in range(len(index.examples)):
        span = slice(index.edges[n], index.edges[n + 1])
        own = dict(zip(index.ids[span].tolist(), index.weigh(index.ids[span].astype(int), index.counts[span]), strict=True))
        out.append((-float(sum(w * own.get(int(i), 0.0) for i, w in zip(ids, weights, strict=True))), n))
    return [(-c, n) for c, n in sorted(out) if c < 0]


def test_index_is_exact(monkeypatch):
    rng = random.Random(2)
    idf = np.array([1 + rng.random() * 5 for _ in range(30)])
    for block, dense in ((4, 0), (64, 7), (16, 96)):
        monkeypatch.setattr(toxicity, "DENSE", dense)
        index = toxicity.BlockMaxIndex(idf, 5.0, block)
        for i in range(400):
            ids = np.array(sorted(rng.sample(range(30), rng.randint(1, 5))))
            index.add(ids, np.array([rng.choice([1, 1, 2, 9]) for _ in ids]), rng.random() < 0.3, i)
        index.close()
        index = pickle.loads(pickle.dumps(index))
        for _ in range(100):
            ids = np.array(sorted(rng.sample(range(30), rng.randint(1, 6))))
            weights = index.weigh(ids, np.array([rng.randint(1, 3) for _ in ids]), rng.choice([0.0, 3.0]))
            best, got = plain_cosines(index, ids, weights)[:7], index.search(ids, weights, 7)
            assert np.allclose([c for c, _ in got], [c for c, _ in best])
            assert {n for c, n in got if c > best[-1][0] + 1e-6} == {n for c, n in best if c > best[-1][0] + 1e-6}


def test_calibration_keeps_order():
    index = toxicity.BlockMaxIndex(np.ones(3), 1.0)
    for i in range(60):
        index.add(np.array([i % 3]), np.array([1 + i // 3]), i % 3 == 0 or i % 7 == 0, i)
    index.close()
    index.set_prior((2, 50))
    index.calibrate(dict(enumerate(index.own_votes(list(range(len(index.examples))), 5))))
    scores = [r[0] for r in index.score([(np.array([i]), np.array([1]), 0.0) for i in range(3)], 5)]
    assert scores[0] > max(scores[1:]) and index.steps[1] == sorted(index.steps[1]) and index.default < 0.3


def isotonic(points):
    """By the definition: the value at i is the greatest of all least means of runs that hold i."""
    points = sorted(points)
    at = sorted({p for p, _ in points})
    ones, size = {p: 0 for p in at}, {p: 0 for p in at}
    for p, label in points:
        ones[p] += label
        size[p] += 1
    above = np.concatenate([[0], np.cumsum([ones[p] for p in at])])
    below = np.concatenate([[0], np.cumsum([size[p] for p in at])])
    n = len(at)
    means = np.full((n, n), np.inf)
    for i in range(n):
        means[i, i:] = (above[i + 1 :] - above[i]) / (below[i + 1 :] - below[i])
    least = np.minimum.accumulate(means[:, ::-1], axis=1)[:, ::-1]
    return {p: max(least[: k + 1, k]) for k, p in enumerate(at)}, at, ones, size


def test_end_to_end_against_brute_force(spark):
    """Vectors, neighbours, votes, calibration and scores of 500 rows, all made again from the definitions."""
    rows, labels = corpus(500, seed=3)
    rows[7], rows[8] = (7, None), (8, "only unseenwordaa unseenwordbb")
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    sent, _ = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    telling = set(sent.value[0].chosen)
    label = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    words = {i: toxicity.words_of(t) for i, t in rows}
    vocabulary = {w for i in label for w in words[i]}

    def features(i):
        known, other = {}, []
        for w, n in words[i].items():
            if w in vocabulary:
                known[w] = known.get(w, 0) + n
            else:
                other.append(n)
            for s in toxicity.stems_of(w):
                if s in telling:
                    known[s] = known.get(s, 0) + n
        return known, other

    made = {i: features(i) for i, _ in rows}
    df = {}
    for known, _ in made.values():
        for f in known:
            df[f] = df.get(f, 0) + 1
    n = len(rows)

    def vector(i):
        known, other = made[i]
        v = {f: (1 + log(k)) * max(0.01, log((1 + n) / (1 + df[f])) * (toxicity.LIFT if f in telling else 1)) for f, k in known.items()}
        length = sqrt(sum(x * x for x in v.values()) + sum((1 + log(k)) ** 2 for k in other) * max(0.01, log((1 + n) / 2)) ** 2)
        return {f: x / length for f, x in v.items()} if length else {}

    unit = {i: vector(i) for i, _ in rows}
    examples = [i for i in sorted(label) if unit[i]]
    empty = [i for i in label if not unit[i]]
    prior = sum(label.values()) / len(label)

    def vote(i):
        near = sorted(((sum(x * unit[e].get(f, 0.0) for f, x in unit[i].items()), e) for e in examples if e != i), reverse=True)[: toxicity.NEIGHBOURS]
        near = [(min(1, c), label[e]) for c, e in near if c > 1e-12]
        if not near:
            return None
        return (toxicity.PRIOR_VOTE * prior + sum(c * y for c, y in near)) / (toxicity.PRIOR_VOTE + sum(c for c, _ in near))

    default = (sum(label[i] for i in empty) + prior) / (len(empty) + 1)
    values, at, ones, size = isotonic([(default if (v := vote(i)) is None else v, label[i]) for i in examples])
    pools = []
    for p in at:
        if not pools or abs(values[p] - pools[-1][3]) > 1e-12:
            pools.append([p, 0, 0, values[p]])
        pools[-1][1] += ones[p]
        pools[-1][2] += size[p]
    steps = np.maximum.accumulate([(o + 2 * p) / (s + 2) for p, o, s, _ in pools])
    for i, _ in rows:
        if i in label and i in examples:
            continue  # such a text has itself among its neighbours
        share = vote(i)
        expected = default if share is None else float(np.interp(share, [p[0] for p in pools], steps))
        assert got[i].score == pytest.approx(expected, abs=1e-6), i
    assert got[7].nearest is None
    assert sum(r.nearest is None for r in got.values()) < 0.05 * n


def test_one_example_for_a_repeated_doc_id(spark):
    docs = spark.createDataFrame([(1, f"copy number {i % 9}") for i in range(300)] + [(2, "clean text"), (5, None)], "doc_id long, text string")
    found = toxicity.labelled(docs, spark.createDataFrame([(1, 1), (2, 0), (5, 0), (None, 1)], "doc_id long, toxic int")).collect()
    assert sorted(r.doc_id for r in found) == [i for i in (1, 2, 5) if zlib.crc32(str(i).encode()) % 4 != 2]


def test_keep_clean_keeps_rows_as_they_are(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame([*rows, (None, None), (None, None), (900, ""), (901, "vilorm grudzok snaff"), (None, "vilorm vilorm grudzok")], "doc_id long, text string")
    docs = docs.selectExpr("text", "doc_id", "1 AS score", "'a' AS `_judged`", "array(1) AS words", "CAST(NULL AS int) AS `a.b`")
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    kept = toxicity.keep_clean(docs, marked)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    predicted = toxicity.toxicity(docs, marked).where("predicted = 1").count()
    assert kept.count() == docs.count() - predicted and predicted > 40
    assert kept.where("doc_id IS NULL").count() == 2 and kept.where("doc_id = 900").count() == 1 and kept.where("doc_id = 901").count() == 0
    assert toxicity.keep_clean(docs.limit(0), marked).count() == 0
