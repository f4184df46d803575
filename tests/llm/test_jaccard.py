import random

import pytest
from pyspark.sql import functions as F
from test_simhash import plain_components

from loomspark.llm import jaccard

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def plain_set(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar(a, b):
    a, b = plain_set(a), plain_set(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"edit{rng.randrange(10**6)}"
    return words


def corpus(copies):
    rng, texts = random.Random(7), []
    for _ in range(10):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))]
        texts += [" ".join(words), " ".join(words).upper(), *(" ".join(edited(rng, words, e)) for e in (1, 2, 3, 5, 9))]
    source = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts += [" ".join(edited(rng, source, rng.randrange(3))) for _ in range(copies)]
    return [*texts, None, "", " \n", "one two", "One  TWO", "one two three four five", "one two three four six"]


def test_components_are_those_of_brute_force(spark):
    texts = corpus(100)
    expected = plain_components(range(len(texts)), lambda a, b: similar(texts[a], texts[b]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = {}
    for r in jaccard.near_duplicates(df).collect():
        labels.setdefault(r.label, []).append(r.doc_id)
    assert sorted(map(sorted, labels.values())) == sorted(sorted(k for k, v in expected.items() if v == root) for root in set(expected.values()))


def test_stage_drops_an_edited_copy(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(5000)}" for _ in range(120)]
    far = edited(rng, words, 20)
    rows = [(3, " ".join(words), "a"), (1, " ".join(edited(rng, words, 1)), "b"), (2, " ".join(edited(rng, words, 2)), "c"), (4, " ".join(far), "d"), (5, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("a.b", F.lit(1))
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def components_of(spark, texts, paired=jaccard.PAIRED):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = {}
    for r in jaccard.near_duplicates(df, paired).collect():
        labels.setdefault(r.label, []).append(r.doc_id)
    return sorted(map(sorted, labels.values()))


def plain_groups(texts):
    expected = plain_components(range(len(texts)), lambda a, b: similar(texts[a], texts[b]))
    return sorted(sorted(k for k, v in expected.items() if v == root) for root in set(expected.values()))


@pytest.mark.parametrize("common", [170, 176, 190])
def test_a_common_passage_neither_hides_pairs_nor_makes_them(spark, common):
    """240 texts under one passage, of which each two are copies of each other but for a word."""
    rng = random.Random(common)
    passage = [f"p{i}" for i in range(common)]
    texts = []
    for _ in range(120):
        own = [f"w{rng.randrange(10**6)}" for _ in range(200 - common)]
        texts += [" ".join(passage + own), " ".join(passage + own[:-1] + [f"e{rng.randrange(10**6)}"])]
    assert components_of(spark, texts) == plain_groups(texts)


def test_two_passages_and_lengths(spark):
    """Texts of many lengths under two passages, with copies that are longer or shorter."""
    rng = random.Random(4)
    passages = [[f"{p}{i}" for i in range(120)] for p in "pq"]
    texts = []
    for n in range(160):
        text = passages[n % 2] + [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(10, 60))]
        cut = text[: max(5, round(len(text) * rng.choice([1, 0.9, 0.85, 0.7])))]
        texts += [" ".join(text), " ".join(cut)]
    assert components_of(spark, texts) == plain_groups(texts)


def composed(rng, common, passages, held, texts):
    """Texts of a common passage and `held` others, each with a copy of which a word or two are edited."""
    out = []
    for _ in range(texts):
        words = [*common, *(w for at in sorted(rng.sample(range(len(passages)), held)) for w in passages[at])]
        out += [" ".join(words), " ".join(edited(rng, words, rng.randrange(1, 3)))]
    return out


@pytest.mark.parametrize("common", [0, 110])
def test_texts_composed_of_frequent_passages(spark, common):
    """Lists are large and most of their texts unlike each other: no leader is similar to both texts of each link."""
    rng = random.Random(common)
    passages = [[f"p{p}w{i}" for i in range(12)] for p in range(8)]
    texts = composed(rng, [f"c{i}" for i in range(common)], passages, 3, 90)
    assert components_of(spark, texts, paired=4) == plain_groups(texts)


def test_lists_of_chains(spark):
    """Chains under one passage, in which a text is like the next but not like the one after some more."""
    rng = random.Random(9)
    passage, texts = [f"p{i}" for i in range(100)], []
    for _ in range(8):
        own = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(12):
            texts.append(" ".join(passage + own))
            at = rng.randrange(56)
            own = own[:at] + [f"w{rng.randrange(10**6)}" for _ in range(5)] + own[at + 5 :]
    assert components_of(spark, texts, paired=3) == plain_groups(texts)


def test_settle_finds_all_links_of_a_list_alone(spark):
    """One list of all texts and no link to begin with; an empty list and a list of one text add nothing."""
    rng = random.Random(3)
    passages = [[f"p{p}w{i}" for i in range(12)] for p in range(8)]
    texts = composed(rng, [f"c{i}" for i in range(60)], passages, 3, 40)
    known = jaccard.sets(spark.createDataFrame([(t,) for t in texts], "text string")).distinct()
    known = jaccard.materialize(known)
    lists = jaccard.materialize(known.selectExpr("1L AS g", "same"))
    none = spark.createDataFrame([], "a long, b long")
    found = {}
    for r in jaccard.settle(lists, known, none, paired=4).collect():
        found.setdefault(r.label, []).append(r.node)
    sets = {r.same: frozenset(r.set) for r in known.collect()}
    ids = sorted(sets)
    near = plain_components(ids, lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    groups = [sorted(k for k, v in near.items() if v == root) for root in set(near.values())]
    assert sorted(sorted(g) for g in found.values()) == sorted(g for g in groups if len(g) > 1)
    assert jaccard.settle(lists.limit(0), known, none).isEmpty() and jaccard.settle(jaccard.materialize(lists.limit(1)), known, none).isEmpty()


def test_fingerprints_give_candidates(spark):
    """The pigeonhole's pairs: all that differ in two bits at most are brought together, as are sets of one fingerprint."""
    rng = random.Random(5)
    prints = [rng.getrandbits(63) for _ in range(60)]
    prints += [p ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for p in prints[:30]] + prints[:10] + [p ^ 7 for p in prints[30:40]]
    table = jaccard.materialize(spark.createDataFrame(list(enumerate(prints)), "same long, fp long"))
    pairs = [(r.a, r.b) for r in jaccard.by_fingerprints(table).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= 2 for a, b in pairs)
    got = plain_components(range(len(prints)), lambda a, b: (a, b) in pairs or (b, a) in pairs)
    assert got == plain_components(range(len(prints)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)


def test_the_stage_takes_candidates_from_fingerprints(spark, monkeypatch):
    """Without any MinHash key a copy with one edited word of many is still found, by its fingerprint, and its tables go but for one."""
    from loomspark.llm import common

    monkeypatch.setattr(jaccard, "in_keys", lambda keyed: spark.createDataFrame([], "same long, key long, n long"))
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join(edited(rng, words, 1))), (3, " ".join(edited(rng, words, 2000))), (4, None)]
    before = len(common._made)
    labels = {r.doc_id: r.label for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert labels[1] == labels[2] and len(set(labels.values())) == 3
    assert len(common._made) == before + 1


def test_settle_compares_what_few_leave_outside_without_narrowing(spark, monkeypatch):
    """More texts than `paired` outside a list's largest component are compared with all of it while that is little work; narrowing multiplies lists."""

    def narrowed(lists, known):
        raise AssertionError("narrowed")

    monkeypatch.setattr(jaccard, "narrowed", narrowed)
    sets = {i: [1, *range(1000 * i + 2, 1000 * i + 50 + i)] for i in range(60)}
    sets[19] = [*sets[13], 7]  # similar to a text of the component that is not the smallest
    known = spark.createDataFrame(list(sets.items()), "same long, set array<long>")
    linked = spark.createDataFrame([(0, i) for i in range(1, 14)], "a long, b long")
    lists = spark.createDataFrame([(g, i) for g, left in ((1, 20), (2, 18)) for i in range(20) if i != left], "g long, same long")
    labels = dict(jaccard.settle(lists, known, linked, paired=4).collect())
    assert {i for i, label in labels.items() if label == 0} == {*range(14), 19} and all(labels.get(i, i) == i for i in range(14, 19))


def test_settle_compares_lists_of_unlike_texts_without_narrowing(spark, monkeypatch):
    """No text of the lists is linked, so nearly all are outside the largest component; their parities are compared in blocks."""

    def narrowed(lists, known):
        raise AssertionError("narrowed")

    monkeypatch.setattr(jaccard, "narrowed", narrowed)
    sets = {i: [1, *range(1000 * i + 2, 1000 * i + 40 + 3 * i)] for i in range(60)}
    for i in range(20, 30):
        sets[i] = [*sets[i + 10], 5]
    known = spark.createDataFrame(list(sets.items()), "same long, set array<long>")
    lists = spark.createDataFrame([(g, i) for g in (1, 2) for i in range(60) if i != g], "g long, same long")
    none = spark.createDataFrame([], "a long, b long")
    labels = dict(jaccard.settle(lists, known, none, paired=4).collect())
    assert labels == {i: 20 + i % 10 for i in range(20, 40)}


@pytest.mark.parametrize("block", [7, 2048])
def test_parities_lose_no_similar_pair(spark, block):
    """Sets of many sizes, on either side of each width of a parity and beyond the widest, at similarities about 0.8; each pair comes once."""
    rng = random.Random(8)
    sets = {}
    for size in (1, 2, 9, 120, 126, 128, 130, 250, 258, 1000, 1040, 20000):
        own = [rng.getrandbits(62) for _ in range(size)]
        for edits in (0, size // 10, size // 9, size // 8):
            for more in (0, size // 9):
                sets[len(sets)] = own[edits:] + [rng.getrandbits(62) for _ in range(edits + more)]
    known = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "same long, set array<long>")
    n = len(sets)
    lists = [(1, i, min(i, 3) if i < 5 else i, n, 3, n - 2) for i in range(n)]
    lists = jaccard.materialize(spark.createDataFrame(lists, "g long, same long, label long, n long, most long, others long"))
    found = [(min(r.a, r.b), max(r.a, r.b)) for r in jaccard.crossing(lists, known, block).collect()]
    plain = {k: frozenset(v) for k, v in sets.items()}
    near = {(a, b) for a in plain for b in plain if a < b and (a, b) != (3, 4) and 5 * len(plain[a] & plain[b]) >= 4 * len(plain[a] | plain[b])}
    assert len(found) == len(set(found)) and near <= set(found) and len(near) > 30
    assert len(found) < 3 * len(near)
