import zlib
from collections import Counter, defaultdict
from itertools import product
from math import exp, log, log10

import numpy as np
import pytest

from loomspark.llm import mixer, mixlm

ROWS = [(i, text) for i, text in enumerate(["the cat sat on the mat", "The dog sat ON the log", "le chat est la", None, "", "  ", "a\x85b c\xa0d É", "cat cat cat"] * 6)]
ROWS += [(None, "the cat"), (3, "twice"), (3, "twice"), (100, "long words " * 5000), (101, "zyzzyva quux unseen"), (102, "w" * 3000)]
BITS64 = (1 << 64) - 1
FACTOR = 0x9E3779B97F4A7C15


def fold(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7


def words(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def stream(text):
    return b"".join(w + b" " for w in words(text)[:-1]) + b"\n"


# --- a plain scorer: one bit at a time, dictionaries in place of tables ---------------------------------------------


def span(data):
    """The hash of bytes: the sum of (byte + 1) times the powers of FACTOR."""
    total = 0
    for i, byte in enumerate(data):
        total += (byte + 1) * pow(FACTOR, i, 1 << 64)
    return total & BITS64


def plain_contexts(data, at):
    """The predictors' hashes before data[at]."""
    before = data[max(0, at - mixer.LOOK) : at].rjust(mixer.LOOK, b"\n")
    current = before.replace(b"\n", b" ").rsplit(b" ", 1)[-1][-32:]
    brief = b""
    for end in range(len(before) - 1, len(before) - 65, -1):
        if before[end] in b" \n":
            word = before[:end].replace(b"\n", b" ").rsplit(b" ", 1)[-1]
            if 1 <= len(word) <= 3:
                brief = word
                break
    h = span(brief) if brief else 0
    h ^= h >> 31
    found = {"short": span(before[-2:]) + h * 0x2545F4914F6CDD1D + 57, "word": span(current) + 101}
    found.update({k: span(before[-k:]) + 7 * k for k in (3, 4, 6)})
    return [found[k] & BITS64 for k in mixer.PREDICTORS]


def plain_line(k, context, more, places):
    h = (context + more) * FACTOR & BITS64
    h ^= h >> 29
    return k, places, (h * FACTOR & BITS64) >> (65 - mixer.LINE_BITS[mixer.PREDICTORS[k]])


def plain_lines(data, at, codes):
    """For each predictor the lines of the byte's group and place."""
    more = ((int(codes[data[at]]) >> 4) + 1) * 0xD6E8FEB86659FD93 & BITS64
    return [(plain_line(k, c, 0, False), plain_line(k, c, more, True)) for k, c in enumerate(plain_contexts(data, at))]


def plain_counts(streams, codes):
    counts = defaultdict(lambda: [0] * 16)
    for data in streams:
        for at, byte in enumerate(data):
            for group, place in plain_lines(data, at, codes):
                counts[group][codes[byte] >> 4] += 1
                counts[place][codes[byte] & 15] += 1
    return counts


def plain_bits(code):
    """(in the place, what is left to choose from, the bit) one after another: is it this group, or a later one; which half of the place."""
    group, place = int(code) >> 4, int(code) & 15
    for i in range(min(group + 1, 15)):
        yield False, (range(i + 1, 16), range(i, i + 1)), int(group == i)
    left = range(16)
    for depth in range(4):
        half = len(left) // 2
        bit = place >> (3 - depth) & 1
        yield True, (left[:half], left[half:]), bit
        left = left[half:] if bit else left[:half]


def plain_logit(counts, line, halves):
    """In steps of 1 / UNIT."""
    if line not in counts:
        return 0
    zeros, ones = (sum(counts[line][i] for i in half) for half in halves)
    n = zeros + ones
    if not n:
        return 0
    raw = log((ones + 0.4) / (zeros + 0.4)) * n / (n + 0.5) * mixer.UNIT
    return (-1 if raw < 0 else 1) if abs(raw) < 0.5 else max(-127, min(127, int(np.round(raw))))


def plain_score(counts, data, model):
    # Mixed logits are float32 here too: a rounding can move one to the next cell of the map.
    one = np.float32
    weights = {(g, k): model.weights[g, k] / one(mixer.UNIT) for g in range(mixer.GATES) for k in range(mixer.INPUTS)}
    ones, sizes = [float(x) for x in model.map], [mixer.MAP_STRENGTH] * mixer.MAP
    total, ends, begin, last, run = 0.0, [32, 64, 128, 256, 512, 1024], 0, {}, 0
    while begin < len(data):
        end = min(next((e for e in ends if e > begin), begin + 1024), len(data))
        steps, times, seen = defaultdict(float), Counter(), []
        for at in range(begin, end):
            six = data[max(0, at - 6) : at].rjust(6, b"\n")
            guess, lines, code = last.get(six), plain_lines(data, at, model.codes), model.codes[data[at]]
            hint = [] if guess is None else list(plain_bits(model.codes[guess]))
            for i, (in_place, halves, bit) in enumerate(plain_bits(code)):
                x = [plain_logit(counts, line[in_place], halves) for line in lines]
                same = i < len(hint) and hint[i][:2] == (in_place, halves) and all(a == b for a, b in zip(hint[:i], plain_bits(code), strict=False))
                gate = (sum(v != 0 for v in x) * 3 + (1 + (run > 5) if same else 0)) * 2 + in_place
                x.append(int(np.round(mixer.UNIT * log(run + 2.0))) * (1 if hint[i][2] else -1) if same else 0)
                mixed = one(0)
                for k, v in enumerate(x):
                    mixed += one(v) * weights[gate, k]
                mixed = float(max(one(-12), min(one(12), mixed)))
                p = 1 / (1 + exp(-mixed))
                node = halves[1][0] + 1 if not in_place else 16 + 8 // len(halves[0]) + halves[0][0] // (2 * len(halves[0]))
                place = node * mixer.STEPS + int(max(0, min(mixer.STEPS - 1, one(mixed) + one(mixer.STEPS / 2))))
                q = max(1e-5, min(1 - 1e-5, (p + ones[place] / sizes[place]) / 2))
                total += log10(q if bit else 1 - q)
                times[gate] += 1
                for k, v in enumerate(x):
                    steps[gate, k] += (bit - p) * v
                seen.append((place, bit))
            run = min(run + 1, 21) if guess == data[at] else 0
            last[six] = data[at]
        for (gate, k), step in steps.items():
            weights[gate, k] += one(mixer.RATE / mixer.UNIT**2 * step / (times[gate] + 30) ** 0.5)
        for place, bit in seen:
            ones[place] += bit
            sizes[place] += 1
        begin = end
    return total


def trained(texts, tuned=()):
    table = np.zeros(mixer.CELLS, np.uint32)
    codes = mixer.ranks(np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256))
    mixer.count(table, texts, codes)
    logits, model = mixer.table_of(table), mixer.Mixer(codes)
    if tuned:
        slope, bend, _ = model.gradients(logits, tuned)
        weights = model.stepped(slope, bend)
        model = mixer.Mixer(codes, weights, mixer.Mixer(codes, weights).gradients(logits, tuned)[2])
    return logits, model


def test_scores_equal_a_plain_scorer():
    texts = [stream(t) for t in ("the cat sat on the mat and the dog ran to it " * 4, "le chat est la " * 9, "É ö \x1f ß", "", "w" * 90)]
    logits, model = trained(texts, [stream("the dog sat on a mat la la"), stream("le chat a été là")])
    counts = plain_counts(texts, model.codes)
    own = [*texts, stream("the dog est la on the mat, the dog est la on the mat"), stream("unseen words: zyzzyva quux " * 60), stream("x")]
    got = model.score(logits, own)
    assert got == pytest.approx([plain_score(counts, d, model) for d in own], rel=1e-6)
    # No text changes another's score, bit for bit.
    assert all(model.score(logits, [d])[0] == s for d, s in zip(own, got, strict=True))


def test_long_texts_go_on_from_piece_to_piece(monkeypatch):
    texts = [stream("the cat sat on the mat and looked at the dog " * 60)]
    logits, model = trained(texts)
    data = stream("mat dog cat other " * 140)
    monkeypatch.setattr(mixer, "GROUP", 64)
    whole = model.score(logits, [data])[0]
    monkeypatch.setattr(mixer, "PIECE", 1024)
    # Only the match predictor looks back to the beginning of a piece, and no further.
    assert model.score(logits, [data])[0] == pytest.approx(whole, rel=0.2)
    table, cut = np.zeros(mixer.CELLS, np.uint32), np.zeros(mixer.CELLS, np.uint32)
    mixer.count(cut, texts, model.codes)
    monkeypatch.undo()
    mixer.count(table, texts, model.codes)
    assert (table == cut).all()


def test_a_distribution_that_learns():
    seen = ["".join(s) for s in product(["ka", "lo", "mi"], repeat=4)]
    np.random.default_rng(1).shuffle(seen)
    logits, model = trained([stream(w) for w in seen[:60]])
    # One more byte in a word, or its end: no two of them together are likelier than the beginning.
    longer = [b"kal" + bytes([b]) for b in range(256)]
    assert sum(10 ** model.score(logits, longer)) <= 10 ** model.score(logits, [b"kal"])[0] + 1e-6
    assert model.score(logits, [stream(seen[70])])[0] > model.score(logits, [stream("qwxzptvb")])[0] + 3
    tuned = trained([stream(w) for w in seen[:60]], [stream(w) for w in seen[60:70]])
    rest = [stream(w) for w in seen[70:]]
    assert tuned[1].score(logits, rest).sum() > model.score(logits, rest).sum()


def test_slices_hold_any_count():
    counts = np.array([0, 1, 255, 256, 70_000, 2**32 - 1, *[0] * (mixlm.SLICE - 6)], np.uint32)
    assert (mixlm.unplanes(mixlm.planes(counts)) == counts).all()
    assert len(mixlm.planes(counts * 0)) == mixlm.SLICE


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS row", "3 AS score", "4 AS c")


@pytest.fixture(scope="module")
def result(docs):
    assert mixlm.score(docs.limit(0)).count() == 0
    return mixlm.score(docs, top_words=3).collect()


def test_counts_and_base_score(result):
    train = Counter()
    for doc_id, text in ROWS:
        if fold(doc_id) != 2:
            train.update(words(text))
    n, v = sum(train.values()), len(train)
    expected = []
    for doc_id, text in ROWS:
        own = words(text)
        base = sum(log10((train[w] + 1) / (n + v + 1)) for w in own)
        expected.append((doc_id, fold(doc_id) == 2, len(own), sum(train[w] > 0 for w in own), n, round(base, 6)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in result]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert any(r.held_out for r in result)


def test_scores_are_those_of_all_training_texts(result):
    by_fold = defaultdict(list)
    for doc_id, text in ROWS:
        by_fold[fold(doc_id)].append(stream(text))
    known = [s for f, own in by_fold.items() if f not in (2, 3) for s in own]
    table, full = np.zeros(mixer.CELLS, np.uint32), np.zeros(mixer.CELLS, np.uint32)
    codes = mixer.ranks(np.bincount(np.frombuffer(b"".join(known + by_fold[3]), np.uint8), minlength=256))
    mixer.count(table, known, codes)
    mixer.count(full, known + by_fold[3], codes)
    model = mixer.Mixer(codes)
    for _ in range(mixlm.ROUNDS):
        slope, bend, seen = model.gradients(mixer.table_of(table), by_fold[3])
        model = mixer.Mixer(codes, model.stepped(slope, bend), seen)
    expected = model.score(mixer.table_of(full), [stream(t) for _, t in ROWS])
    assert sorted(r.score for r in result) == sorted(expected)
    assert all(r.bits_per_byte > 0 for r in result)


def test_the_same_for_any_partitions(spark, docs, result):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        again = mixlm.score(docs.repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(r.score for r in again) == sorted(r.score for r in result)


def test_better_than_base_on_text_it_has_not_seen(spark):
    rng = np.random.default_rng(0)
    languages = [["".join(rng.choice(list(s), 3)) for _ in range(150)] for s in ("abcdef", "ghijkl", "mnopqr")]
    rows = [(i, " ".join(rng.choice(languages[i % 3], 60))) for i in range(300)]
    got = mixlm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 1000
