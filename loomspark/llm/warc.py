"""Web archives with a dictionary of their own: WARC 1.1 records, each one Zstandard frame.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed, so that it can be read
without anything else; every record is then a frame, which the dictionary makes small although it is compressed alone, and can
be read alone, from its offset. The dictionary is trained in the task that writes the archive, on the archive's first
records up to SAMPLE_BYTES (a bounded sample; records lie in the order of a hash); with too few records for a training there
is none. Spark's text writer writes the files, with its committer: a row is a frame, and the end of a line is an empty
skippable frame, which readers of Zstandard pass over.

Records of equal payloads of at least min_bytes bytes are revisits of the one with the smallest page_id, then by a
hash of page_id, url and payload. Only counts and digests are grouped, html is shuffled once, and rows that are alike in
page_id, url and payload travel as one with a count if they are many. A digest with many rows meets its response by
graph.lookup(). Reading takes an archive a task and finds frames by their headers; payloads are hashed again and compared with what the
record says, and revisits find their response by its record's name.

Defined results: null html is empty; a null page_id is larger than all others and stays null; a null url has no target field; spaces
and control characters in a url are percent-encoded; of rows alike in every column one is the response; other columns are
ignored; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, work_dir
from .graph import HOT_SHARE, lookup

#: Fixed values of the formats.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
EMPTY_FRAME = struct.pack("<II", SKIPPABLE, 0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload of an archive, and the least for the sake of more tasks.
ARCHIVE_BYTES, ARCHIVE_LEAST = 1 << 28, 1 << 23
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 21, 1 << 16
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"


# ---- frames and records


def frames(data: memoryview) -> Iterator[tuple[int, int, int]]:
    """(start, end, magic) of each frame, by the headers of frames and blocks alone."""
    at = 0
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError(f"the frame at byte {at} is cut off")
        (magic,) = struct.unpack_from("<I", data, at)
        if magic & ~0xF == SKIPPABLE:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic == FRAME:
            flags = data[at + 4]
            single = flags >> 5 & 1
            end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
            last = 0
            while not last:
                head = int.from_bytes(data[end : end + 3], "little")
                last, kind = head & 1, head >> 1 & 3
                end += 3 + (1 if kind == 1 else head >> 3)
            end += 4 * (flags >> 2 & 1)
        else:
            raise ValueError(f"no frame begins at byte {at}")
        if end > len(data):
            raise ValueError(f"the frame at byte {at} is cut off")
        yield at, end, magic
        at = end


def skippable(content: bytes, magic: int) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_name(ident: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{ident}:{copy}'.encode()).digest()[:16], version=5)}>"


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(fields: list[tuple[str, str | None]], payload: bytes | None, size: int) -> bytes:
    """A record with these fields; its block is an HTTP response of size bytes, or of a revisit its head only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (payload or b"")
    own = [*fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in own if v is not None)
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The fields of a record, their names in small letters, and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class ArchiveWriter:
    """Frames of an archive from its records, in order; the first SAMPLE_BYTES wait for the dictionary that they make."""

    def __init__(self, sample_bytes: int = SAMPLE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL):
        self.sample_bytes, self.dictionary_bytes, self.level = sample_bytes, dictionary_bytes, level
        self.waiting: list[bytes] = []
        self.size = 0
        self.compressor = None

    def add(self, data: bytes) -> list[bytes]:
        if self.compressor:
            return [self.compressor.compress(data)]
        self.waiting.append(data)
        self.size += len(data)
        return self.begin() if self.size >= self.sample_bytes else []

    def begin(self) -> list[bytes]:
        """Train on what waits and write it; also the end of an archive that is smaller than the sample."""
        import zstandard

        if self.compressor or not self.waiting:
            return []
        out, dictionary = [], None
        try:
            # A record longer than a share of the sample would leave no room for others.
            parts = [r[: self.sample_bytes // 8] for r in self.waiting]
            dictionary = zstandard.train_dictionary(min(self.dictionary_bytes, max(256, self.size // 8)), parts, k=256, d=8)
        except zstandard.ZstdError:
            pass
        if dictionary:
            out.append(skippable(zstandard.ZstdCompressor(level=self.level).compress(dictionary.as_bytes()), DICTIONARY))
            dictionary.precompute_compress(level=self.level)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary, write_checksum=True)
        out += [self.compressor.compress(r) for r in self.waiting]
        self.waiting = []
        return out


def records_of(data: memoryview) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each record of an archive."""
    import zstandard

    opener = zstandard.ZstdDecompressor()
    for start, end, magic in frames(data):
        if magic == DICTIONARY and start == 0:
            content = bytes(data[8:end])
            if content[:4] == struct.pack("<I", FRAME):
                content = opener.decompressobj().decompress(content)
            opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        elif magic == FRAME:
            yield start, opener.decompressobj().decompress(data[start:end])


# ---- tables


def _hashed(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    named = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    known = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("page_id", "url")]
    return named.withColumn("ident", F.sha1(F.concat_ws("\n", *known, "digest").cast("binary")))


def _roles(hashed: DataFrame, min_bytes: int) -> DataFrame:
    """A row for each different (page_id, url, payload): how many of its rows are responses and revisits, and of which response."""
    light = materialize(hashed.groupBy("page_id", "url", "digest", "ident", F.octet_length("payload").cast("long").alias("size")).agg(F.count("*").alias("n")))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "ident", "url")
    best = light.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min(order).alias("best")).select("digest", F.col("best.ident").alias("to_ident"), F.col("best.url").alias("to_url"))
    joined = lookup(light, best, "digest")
    responses = F.when(F.col("to_ident").isNull() | (F.col("size") < min_bytes), F.col("n")).when(F.col("ident") == F.col("to_ident"), 1).otherwise(0)
    return joined.withColumn("responses", responses.cast("long"))


def _writer(date: str, settings: dict[str, int]):
    out = pa.schema([("frame", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, role, payload = ArchiveWriter(**settings), {}, None

        def common(kind: str, copy: int) -> list[tuple[str, str | None]]:
            uri = role["url"] and _uri(role["url"])
            page = None if role["page_id"] is None else str(role["page_id"])
            digest = "sha1:" + base32(bytes.fromhex(role["digest"]))
            return [("WARC-Type", kind), ("WARC-Record-ID", record_name(role["ident"], copy)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("X-Page-ID", page)]

        def emit(found: list[bytes]) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], schema=out)

        for batch in batches:
            found: list[bytes] = []
            for row in batch.to_pylist():
                if row["payload"] is None:  # a role comes before the payloads of its rows
                    role, payload = row, None
                    refers = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_name(row["to_ident"] or "", 0)), ("WARC-Refers-To-Target-URI", row["to_url"] and _uri(row["to_url"])), ("WARC-Refers-To-Date", date)]
                    for copy in range(row["responses"], row["n"]):
                        found += archive.add(record([*common("revisit", copy), *refers], None, row["size"]))
                        if len(found) == 1000:
                            yield from emit(found)
                            found = []
                elif payload is None and role["responses"]:
                    payload = row["payload"]
                    for copy in range(role["responses"]):
                        found += archive.add(record(common("response", copy), payload, len(payload)))
                        yield from emit(found)
                        found = []
            yield from emit(found)
        yield from emit(archive.begin())

    return write


def write_archives(pages: DataFrame, min_bytes: int = 0, path: str | None = None, date: str = DATE, **settings: int) -> str:
    """Write a record for each row of pages (page_id, url, html) and return the folder of the archives, `*.warc.zst`."""
    spark = pages.sparkSession
    path = path or work_dir(spark)
    hashed = _hashed(pages)
    roles = materialize(_roles(hashed, min_bytes))
    rows, size = roles.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("size") * F.col("responses")), F.lit(0))).first()
    archives = max(1, -(-size // ARCHIVE_BYTES), min(spark.sparkContext.defaultParallelism, -(-size // ARCHIVE_LEAST)))
    payloads = hashed.select("ident", "payload")
    hot = materialize(roles.where(F.col("n") * HOT_SHARE > F.lit(rows)).where("n > 1").select("ident"))  # HOT_SHARE at most
    if not hot.isEmpty():
        once = payloads.join(F.broadcast(hot), "ident", "left_semi").groupBy("ident").agg(F.min("payload").alias("payload"))
        payloads = payloads.join(F.broadcast(hot), "ident", "left_anti").unionByName(once)
    both = roles.unionByName(payloads, allowMissingColumns=True)
    dealt = both.repartition(archives, "ident").sortWithinPartitions("ident", F.col("payload").isNotNull())
    lines = dealt.mapInArrow(_writer(date, settings), "frame binary").select(F.col("frame").cast("string").alias("value"))
    lines.write.option("lineSep", EMPTY_FRAME.decode()).text(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".txt") and status.getLen():
            files.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name.split("-c000")[0] + ".warc.zst"))
    return path


def read_records(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row for each record of archives (path, content): where it is, its fields, and the length and digest of its payload.

    payloads also gives the payload, null for revisits. A payload that does not have the digest that its record states is an error.
    """
    names = ["archive", "offset", "record_id", "record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to_id"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    fields = pa.schema([*zip(names, kinds, strict=True), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for offset, data in records_of(memoryview(content.as_buffer())):
                    about, payload = parse(data)
                    kind, stated = about["warc-type"], about["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and base32(hashlib.sha1(payload).digest()) != stated:
                        raise ValueError(f"{path}, byte {offset}: the payload does not have its digest")
                    own = kind == "response"
                    rows.append((path, offset, about["warc-record-id"], kind, about.get("x-page-id"), about.get("warc-target-uri"), len(payload) if own else None, stated, about.get("warc-refers-to"), payload if payloads and own else None))
                    size += len(payload)
                    if len(rows) == 1000 or size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    schema = "archive string, offset long, record_id string, record_type string, page_id string, url string, payload_bytes long, payload_digest string, refers_to_id string, payload binary"
    found = archives.select("path", "content").mapInArrow(read, schema)
    return found if payloads else found.drop("payload")


def open_archives(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "content")


def resolved(records: DataFrame, page_id: str = "bigint") -> DataFrame:
    """records with their revisits' payload_bytes and refers_to (a page_id) taken from the responses that they name."""
    records = records.select("record_id", "record_type", "payload_bytes", "payload_digest", "refers_to_id", F.col("page_id").cast(page_id).alias("page_id"), "url", "archive", "offset")
    kept = materialize(records)
    named = kept.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest"))
    revisits = lookup(materialize(kept.where("record_type = 'revisit'")), named, "refers_to_id")
    same = F.when(F.col("full_digest") == F.col("payload_digest"), F.col("full_bytes"))
    done = revisits.withColumn("payload_bytes", F.coalesce(same, F.raise_error(F.lit("a revisit's response is missing or differs")).cast("long")))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "archive", "offset"]
    responses = kept.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast(page_id))
    return responses.select(columns).unionByName(done.select(columns))


def through_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and place of every row of pages, read back from archives of them."""
    spark = pages.sparkSession
    path = write_archives(pages, min_bytes)
    return resolved(read_records(open_archives(spark, path)), pages.schema["page_id"].dataType.simpleString())
