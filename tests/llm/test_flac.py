import os
import subprocess
import sys
import hashlib
import struct
import zlib

import numpy as np
import pytest

from loomspark.llm import flac


def payloads():
    rng = np.random.default_rng(0)
    wave = (128 + 100 * np.sin(np.arange(12800) / 9)).astype(np.uint8).tobytes()
    return [
        bytes(64), bytes(1024 * 3 + 64), rng.integers(0, 256, 6400, dtype=np.uint8).tobytes(), bytes([0, 255] * 3200), (b"a" * 63 + b"\xff") * 100, wave,
        bytes([128] * 1000 + [0] * 24), flac.payload_of("Some text, é and 中. ".encode() * 300), flac.payload_of(b"x" * (flac.BATCH * 4 + 77)),
    ]


def test_round_trip_and_kinds():
    data = payloads()
    media = flac.encode(data)
    assert flac.decode(media) == data
    assert len(media[1]) < 200 and len(media[5]) < 0.4 * len(data[5]) and len(media[2]) < 1.05 * len(data[2])
    kinds = {f[len(flac.frame_header(0, 1024))] >> 1 for m in media for f in list(flac._cut(m, flac.Layout(m)))[:1] if f[2] == 0xA0}
    assert {0, 1} <= kinds and kinds & {8, 9, 10, 11, 31 + flac.LPC_ORDER}
    assert flac.encode([data[4]])[0] == media[4]
    with pytest.raises(ValueError):
        flac.encode([b"x"])


def test_seek_decodes_any_block():
    data = payloads()[5]
    media = flac.encode([data])[0]
    for at, n in ((0, 1), (1023, 2), (3000, 5000), (12799, 1), (12000, 99999)):
        assert flac.seek(media, at, n) == data[at : at + n]


def test_damage_is_found():
    media = flac.encode([payloads()[4]])[0]
    start = flac.Layout(media).start
    for at in (start + 2, start + 40, len(media) - 1, 4 + 4 + 20):
        broken = bytearray(media)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, width):
        self.text += format(value & (1 << width) - 1, f"0{width}b") if width else ""

    def rice(self, v, k):
        u = v * 2 if v >= 0 else -v * 2 - 1
        self.text += "0" * (u >> k) + "1"
        self.put(u, k)

    def bytes(self):
        self.text += "0" * (-len(self.text) % 8)
        return bytes(int(self.text[i : i + 8], 2) for i in range(0, len(self.text), 8))


def hand_made(kind, samples, method=0, escaped=False):
    """A frame made bit by bit: fixed order 4, or LPC of order 9, with two partitions."""
    head = bytes([0xFF, 0xF8, 0x70, 0x02, 0x05]) + struct.pack(">H", len(samples) - 1)
    bits, order = Bits(), 4 if kind == "fixed" else 9
    bits.put((8 + 4) << 1 if kind == "fixed" else (32 + 8) << 1, 8)
    for s in samples[:order]:
        bits.put(s, 8)
    coefficients, shift = ([4, -6, 4, -1], 0) if kind == "fixed" else ([3, -1, 0, 2, 1, 0, 0, -2, 5], 3)
    if kind == "lpc":
        bits.put(6, 4)
        bits.put(shift, 5)
        for c in coefficients:
            bits.put(c, 7)
    residual = [s - (sum(c * samples[i - 1 - j] for j, c in enumerate(coefficients)) >> shift) for i, s in enumerate(samples) if i >= order]
    bits.put(method, 2)
    bits.put(1, 4)
    half = len(samples) // 2
    for n, part in enumerate((residual[: half - order], residual[half - order :])):
        if escaped and n:
            bits.put((1 << 4 + method) - 1, 4 + method)
            bits.put(13, 5)
            for r in part:
                bits.put(r, 13)
        else:
            bits.put(1, 4 + method)  # small, so that some runs of zeros are long
            for r in part:
                bits.rice(r, 1)
    frame = head + bytes([flac.crc8(head)]) + bits.bytes()
    crc = 0
    for byte in frame:  # bit by bit
        for i in range(7, -1, -1):
            carry = (crc >> 15) ^ (byte >> i & 1)
            crc = (crc << 1 & 0xFFFF) ^ (0x8005 if carry else 0)
    return frame + crc.to_bytes(2, "big")


@pytest.mark.parametrize("kind", ["fixed", "lpc"])
@pytest.mark.parametrize("method", [0, 1])
@pytest.mark.parametrize("escaped", [False, True])
def test_decoder_reads_frames_made_by_hand(kind, method, escaped):
    rng = np.random.default_rng(1)
    smooth = np.clip(np.cumsum(rng.integers(-9, 10, 200)), -128, 127).tolist()
    frames = [hand_made(kind, smooth, method, escaped), hand_made("fixed", [127, -128] * 50, method, escaped)]
    assert [x.tolist() for x in flac.decode_frames(frames)] == [smooth, [127, -128] * 50]


def test_rows(spark):
    rows = [(3, "héllo " * 999), (1, None), (2, ""), (None, "x" * 64), (3, "héllo " * 999), (9, "y" * 65)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS n_bytes", "3 AS feature")
    stored = flac.store(docs)
    got = flac.read_features(stored).collect()
    expected = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        expected.append((doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=repr) == sorted(expected, key=repr)
    same = [r for r in got if r.doc_id == 3]
    assert same[0] == same[1]
    media = {r.doc_id: bytes(r.media) for r in stored.collect()}
    assert all(r.media_bytes == len(media[r.doc_id]) and r.media_sha256 == hashlib.sha256(media[r.doc_id]).hexdigest() for r in got)
    blocks = sorted((r.sample_offset, bytes(r.pcm)) for r in flac.pcm_blocks(stored.where("doc_id = 9"), 40).collect())
    assert [a for a, _ in blocks] == [0, 40, 80, 120] and b"".join(b for _, b in blocks) == b"y" * 65 + bytes(63)
    assert flac.read_features(flac.store(docs.limit(0))).count() == 0


def test_query_reads_media_and_blocks_from_storage(spark, tmp_path):
    from loomspark.llm import common, queries

    rows = [(3, "héllo " * 99), (1, None), (None, "x" * 64), (3, "héllo " * 99)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), len(common._made)
    got = queries.op6_flac_media(spark, str(tmp_path))
    media, blocks = (spark.read.parquet(p) for p in common._made[before:])
    assert got.inputFiles() and all(f in blocks.inputFiles() for f in got.inputFiles())
    assert sorted(map(repr, got.collect())) == sorted(map(repr, flac.read_features(flac.store(docs)).collect()))
    assert media.columns == ["doc_id", "n_bytes", "media"] and media.count() == 4
    cut = flac.decoded(media.where("doc_id = 3"), 100).first().blocks
    assert [b.sample_offset for b in cut] == list(range(0, 704, 100)) and b"".join(bytes(b.pcm) for b in cut) == flac.payload_of(rows[0][1].encode())


def test_pcm_goes_in_waves(spark):
    """Of larger media the PCM of one wave at most lies beside it, and every row's features still come from PCM that was read again."""
    from loomspark.llm import common

    rows = [(i if i % 7 else None, None if i % 11 == 0 else f"text {i % 30} " * (i % 40)) for i in range(200)]
    docs, before = spark.createDataFrame(rows, "doc_id long, text string").repartition(15), common.written()
    held, whole = [], flac.materialize

    def spy(df, *rest, **more):
        made = whole(df, *rest, **more)
        held.append([f for f in map(spark.read.parquet, common._made[before:]) if "blocks" in f.columns])
        return made

    flac.materialize = spy
    try:
        got = flac.through_storage(docs, wave=0)
    finally:
        flac.materialize = whole
    assert sum(map(len, held)) == 24 and max(map(len, held)) == 1  # a wave's PCM lies there when it and when its features are written
    assert not [f for f in map(spark.read.parquet, common._made[before:]) if "blocks" in f.columns]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, flac.read_features(flac.store(docs)).collect()))
    assert flac.through_storage(docs.limit(0), wave=0).count() == 0


def test_more_frames_than_seek_points(monkeypatch):
    """Points at equal distances, and frames between them found by their checksums; a stream without points too."""
    rng = np.random.default_rng(4)
    payload = (bytes(rng.integers(0, 256, 20_000, np.uint8)) + b"plain words again \xff\xf8\xff\xf8 and " * 3000)[: 64 * 1500]
    whole = flac.encode([payload])[0]
    monkeypatch.setattr(flac, "POINTS", 7)
    few = flac.encode([payload])[0]
    assert len(flac.Layout(few).first) <= 7 and flac.decode([few, whole]) == [payload, payload]
    for at, n in ((0, 10), (5000, 3000), (95_000, 1000), (40_000, 1)):
        assert flac.seek(few, at, n) == payload[at : at + n]
    layout = flac.Layout(few)
    info = b"\x80" + few[5:42]
    assert flac.decode([b"fLaC" + info + few[layout.start :]]) == [payload]
    with pytest.raises(ValueError):
        flac.decode([few[:-300] + bytes([few[-300] ^ 1]) + few[-299:]])


def test_memory_does_not_grow_with_the_frames(tmp_path):
    """Beyond the bytes of text and media themselves, decoding holds a batch of frames: 2 and 24 MB peak alike."""
    code = """
import resource, sys
from loomspark.llm import flac
payload = (b"some words of a text, " * 64 * int(sys.argv[1]))[: 1024 * 1024 * int(sys.argv[1]) // 24 * 24 // 64 * 64]
media = flac.encode([payload])[0]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert flac.decode([media])[0] == payload
print(before, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, len(payload) // 1024)
"""
    peaks = []
    for size in ("2000", "24000"):
        before, after, kilobytes = map(int, subprocess.run([sys.executable, "-c", code, size], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__)))).stdout.split())
        peaks.append(after - 4 * kilobytes)
    assert peaks[1] < peaks[0] + 120_000
