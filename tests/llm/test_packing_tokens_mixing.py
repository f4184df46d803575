import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from loomspark.llm import mixing, packing, simple8b
from loomspark.llm.tokens import Encoder

ROWS = [
    (5, "The cat's 3 hats, don't!", "b"), (1, None, "a"), (2, "", None), (9, "x " * 30000, "a"), (2, "", None),
    (None, "no id at all", "b"), (7, "<|endoftext|> Σίσυφος x\x85y", ""), (3, "tie", "c"), (4, "tie", "c"), (3, "tie", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.selectExpr("*", "'x' AS length", "1 AS piece", "2 AS sequence_id", "3 AS offset", "4 AS size", "5 AS shard", "6 AS bucket")


@pytest.fixture(scope="module")
def reference(vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    return lambda text: library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library(vocabulary, reference):
    encoder, rng = Encoder(vocabulary, cached_runs=50), random.Random(3)
    signs = "ab'sdmltrev .!\n\t12½²ªµ×÷ßŉĀŐſÀŸİΣ \x85\x1c中́"
    for _ in range(5000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference(text), repr(text)


def test_other_vocabularies_go_to_the_library(vocabulary):
    from tokenizers import Tokenizer

    other = os.path.join(os.path.dirname(vocabulary), "byte_bpe_50k.json")
    if not os.path.exists(other):
        pytest.skip("one vocabulary only")
    library, encoder = Tokenizer.from_file(other), Encoder(other)
    for text in ("Hello World, it's 2024!", "  two  spaces\tand tab ", "ÉA b", ""):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert not encoder.splits and Encoder(vocabulary).splits


def test_packing_keeps_every_id_once(spark, docs, vocabulary, reference):
    rows = packing.best_fit_pack(docs, vocabulary, keep_ids=True).collect()
    expected = []
    for doc_id, text, _ in ROWS:
        ids = [*reference(text), 1]
        expected += [(doc_id, at // 4096, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])) for at in range(0, len(ids), 4096)]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(expected, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.best_fit_pack(docs.limit(0), vocabulary).count() == 0


def test_best_fit_is_bounded_and_chooses_the_tightest():
    bins, rng, open_now = packing.BestFit(100, 5), random.Random(0), {}
    for _ in range(3000):
        n = rng.randint(1, 100)
        tightest = min((free for free in open_now.values() if free >= n), default=None)
        sequence, offset = bins.place(n)
        if tightest is None:
            assert sequence not in open_now and offset == 0
            free = 100
        else:
            assert open_now[sequence] == tightest and offset == 100 - tightest
            free = open_now.pop(sequence)
        if free - n:
            if len(open_now) == 5:
                fullest = min(open_now.values())
                gone = [s for s in open_now if s in {x for stack in bins.by_space for x in stack} ^ set(open_now) and open_now[s] == fullest]
                assert len(gone) == 1
                del open_now[gone[0]]
            open_now[sequence] = free - n
        assert {s: f for f, stack in enumerate(bins.by_space) for s in stack} == open_now
    with pytest.raises(ValueError):
        bins.place(101)


def test_packing_is_close_to_the_bound():
    rng = random.Random(1)
    lengths = sorted((min(4096, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(20000)), reverse=True)
    bins = packing.BestFit()
    for n in lengths:
        bins.place(n)
    assert bins.made <= 1.01 * -(-sum(lengths) // 4096) + 1


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 9000])
@pytest.mark.parametrize("high", [1, 2, 300, 49408, 2**40, 2**63])
def test_simple8b_round_trip(n, high):
    values = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64)
    values[::13] = 0
    segment = simple8b.encode(values)
    assert (simple8b.decode(segment) == values).all()
    assert (simple8b.decode(segment, 1, 3) == values[1024:3072]).all()


def test_simple8b_packs_and_escapes():
    values = np.zeros(5000, np.uint64)
    values[[10, 4999]] = [2**64 - 1, 2**60]
    segment = simple8b.encode(values)
    assert (simple8b.decode(segment) == values).all() and len(segment) < 700
    with pytest.raises(ValueError):
        simple8b.decode(b"nope" + segment[4:])


def test_token_files(spark, docs, vocabulary, reference):
    for segment_ids in (1, 1 << 18):
        rows = simple8b.read_token_files(simple8b.write_token_files(docs, vocabulary, segment_ids=segment_ids), keep_ids=True).collect()
        assert len(rows) == len(ROWS)
        rows.sort(key=lambda r: r.start)
        assert [r.doc_id for r in rows] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x or 0))
        at = 0
        for r in rows:
            assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == crc(r.ids)
            at += r.n_tokens
        assert sorted(map(tuple, (r.ids for r in rows))) == sorted((*reference(t), 2) for _, t, _ in ROWS)
    assert simple8b.read_token_files(simple8b.write_token_files(docs.limit(0), vocabulary)).count() == 0


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > 2 * sizes[s]]
        if not over:
            target |= part
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mixing(spark, docs):
    rng = random.Random(5)
    many = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "a", "a", "é", "z", None, "b"])) for i in range(1500)]
    for data in (ROWS, many):
        df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
        rows = mixing.mixing_report(df, buckets=7).collect()
        assert len(rows) == len(data)
        sizes = {}
        for _, text, source in data:
            sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
        targets = plain_targets(sizes)
        assert sorted(round(r.target, 6) for r in rows) == sorted(round(targets[d[2]], 6) for d in data)
        for source, target in targets.items():
            own = [r for r in rows if abs(r.target - target) < 1e-6 and r.source_size == sizes[source]]
            same = sum(1 for s in targets if sizes[s] == sizes[source] and abs(targets[s] - target) < 1e-6)
            assert abs(sum(r.taken for r in own) / same - target) <= max(r.size for r in own) / 2 + 1e-6
            assert all(r.taken <= 2 * r.size for r in own)
        assert sorted(map(tuple, mixing.mixing_report(df.repartition(3), buckets=100).collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def plain_positions(data):
    """{row number: positions}, document by document; the schedule's demand D(u) is inverted by bisection."""
    sizes, order = {}, {}
    for i, (doc_id, text, source) in enumerate(data):
        n = len((text or "").encode().split())
        sizes[source] = sizes.get(source, 0) + n
        inner = "" if text is None else hashlib.md5(text.encode()).hexdigest()
        order.setdefault(source, []).append((hashlib.md5(f"{'' if doc_id is None else doc_id}:{inner}".encode()).hexdigest(), i, n))
    targets, out = plain_targets(sizes), {}
    ranked = sorted(sizes, key=lambda s: (s is None, s))
    for source, rows in order.items():
        begin, tilt, target = 0, mixing.TILTS[ranked.index(source) % 3], targets[source]
        demand = lambda u, tilt=tilt, target=target: target * ((1 + tilt) * u - tilt * u * u)
        for _, i, n in sorted(rows):
            out[i] = []
            for c in (0, 1):
                middle = c * sizes[source] + begin + n / 2
                if n and middle < target:
                    low, high = 0.0, 1.0
                    for _ in range(60):
                        u = (low + high) / 2
                        low, high = (u, high) if demand(u) < middle else (low, u)
                    out[i].append(low)
            begin += n
    return out


def test_positions_invert_the_schedule(spark):
    rng = random.Random(11)
    data = [(rng.choice([i, None, 7]), " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])) + rng.choice(["", f" {i}"]), rng.choice(["a", "a", "a", "é", None, "b"])) for i in range(900)]
    data += [(1, "equal rows here", "a")] * 300
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    rows = mixing.mixing_report(df, buckets=5).collect()
    expected = plain_positions(data)
    got = sorted((repr(r.doc_id), r.size, [round(u, 9) for u in r.positions]) for r in rows)
    assert got == sorted((repr(d), len((t or "").split()), [round(u, 9) for u in expected[i]]) for i, (d, t, _) in enumerate(data))
    first = [r.positions[0] if r.positions else 2.0 for r in rows]
    assert first == sorted(first)
    # The stream has every copy, in the order of positions.
    stream = sorted((u, data[i][1]) for i, own in expected.items() for u in own)
    mixed = [r.text for r in mixing.mix(df, buckets=5).collect()]
    assert [len(t) for t in mixed] == [len(t) for _, t in stream] or sorted(mixed) == sorted(t for _, t in stream)
    assert sum(a == b[1] for a, b in zip(mixed, stream, strict=True)) > 0.95 * len(stream)


def test_mixed_stream(spark, docs):
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    report = {}
    for r in mixing.mixing_report(docs).collect():
        report[r.doc_id] = report.get(r.doc_id, 0) + r.taken
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.encode().split())
    assert got == {k: v for k, v in report.items() if v}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixing_report(docs.limit(0)).count() == 0
