"""Archives: round trips, roles against a plain rule, archives that the library alone can open, and damaged ones."""

import base64
import hashlib
import random
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from loomspark.llm import warc

SCHEMA = "page_id long, url string, html string"


def plain(rows, min_bytes=0):
    groups = {}
    for page_id, url, html in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    out = []
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        ids.sort(key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            revisit = k > 0 and len(payload) >= min_bytes
            out.append((i, len(payload), digest, "revisit" if revisit else "response", ids[0] if revisit else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def made(seed, n=400):
    rng = random.Random(seed)
    words = ["<p>", "</p>", "Ünïcode", "and", "the", "news", "\r\n\r\n", "\x00", "WARC/1.1"]
    bodies = ["", None, "x" * 300_000] + [" ".join(rng.choices(words, k=rng.randrange(1, 80))) for _ in range(n // 2)]
    urls = ["http://h/a b", "http://h/\r\nX: y", None, "", "http://h/é"]
    return [(rng.choice([None, i, i, i, 5]), rng.choice(urls), rng.choice(bodies)) for i in range(n)]


@pytest.mark.parametrize("min_bytes", [0, 40])
def test_round_trip_equals_the_plain_rule(spark, min_bytes):
    rows = made(1)
    rows += rows[:50] + [(9, "u", "<html>hot</html>")] * 700  # alike in every column
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"digest": F.lit(1), "payload": F.lit("p"), "ident": F.lit("i")})
    assert got(warc.through_archives(df, min_bytes)) == plain(rows, min_bytes)


def test_payloads_and_urls_come_back(spark):
    rows = [r for r in made(2) if r[0] is not None]
    path = warc.write_archives(spark.createDataFrame(rows, SCHEMA))
    records = warc.read_records(warc.open_archives(spark, path), payloads=True).collect()
    assert len(records) == len(rows)
    assert {bytes(r.payload).decode() for r in records if r.payload is not None} == {h or "" for _, _, h in rows}
    assert {r.url for r in records} == {None, "http://h/a%20b", "http://h/%0D%0AX:%20y", "http://h/é", ""}
    assert len({r.record_id for r in records}) == len(records)


def test_an_archive_opens_with_its_own_dictionary_and_each_record_alone(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = [(i, f"http://h/{i}", f"<html><body>{' '.join(rng.choices(vocabulary, k=60))}</body></html>") for i in range(2000)]
    path = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(4))
    archives = warc.open_archives(spark, path).collect()
    assert archives
    for a in archives:
        data = bytes(a.content)
        assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY
        size = struct.unpack_from("<I", data, 4)[0]
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        plain_size = 0
        for offset, record in warc.records_of(memoryview(data)):
            assert zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(data[offset:]) == record
            plain_size += len(zstandard.compress(record, 3))
        assert len(data) < plain_size


def test_few_records_and_none(spark):
    assert got(warc.through_archives(spark.createDataFrame([(1, "u", "a")], SCHEMA))) == plain([(1, "u", "a")])
    assert got(warc.through_archives(spark.createDataFrame([], SCHEMA))) == []


def test_frames_of_all_kinds():
    big, rle = random.Random(4).randbytes(400_000), b"a" * 300_000
    for checksum in (True, False):
        for sized in (True, False):
            packer = zstandard.ZstdCompressor(write_checksum=checksum, write_content_size=sized)
            parts = [packer.compress(x) for x in (b"", b"x", big, rle)] + [warc.EMPTY_FRAME]
            data = b"".join(parts)
            assert [data[s:e] for s, e, _ in warc.frames(memoryview(data))] == parts
    for bad in (data[:-1], b"junk" + data, parts[2][:-1]):
        with pytest.raises(ValueError):
            list(warc.frames(memoryview(bad)))


def test_a_payload_without_its_digest_is_an_error(spark):
    data = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<a>"), ("WARC-Payload-Digest", "sha1:AAAA")], b"x", 1)
    archives = spark.createDataFrame([("p", bytearray(zstandard.compress(data)))], "path string, content binary")
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_records(archives).collect()
