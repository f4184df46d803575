"""Simple-8b: word-aligned coding of ids, and token-ID files made of it.

A 64-bit word has a 4-bit selector in its top bits and 60 bits of payload, first value lowest. The
selectors (fixed values) pack as many values as the width of the widest allows. Selector 0 marks a
value of more than 60 bits: its payload is the value's place in the segment's list of escapes.
Selector 1 is a run of 120 zeros.

Ids are coded in blocks of 1024. No word crosses a block, and the segment lists each block's first
word, so any block can be decoded alone and all blocks are coded and decoded at once by array
operations. A segment is a header, the block offsets, the escapes and the words, little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, shuffle_partitions
from .tokens import encoder

BLOCK = 1024
#: Values in a word and bits of a value, by selector (fixed values of the format).
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
HEADER = struct.Struct("<4sIQQQ")  # magic, block length, ids, escapes, words
MAGIC = b"S8B1"
END_ID = 2
#: A file row holds whole documents of about so many ids.
SEGMENT_IDS = 1 << 18


def encode(values: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment with these unsigned 64-bit values."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    blocks = -(-n // block)
    grid = np.zeros((blocks, block), np.uint64)
    grid.reshape(-1)[:n] = values
    ends = np.full(blocks, block)
    if n % block:
        ends[-1] = n % block
    escaped = grid >> np.uint64(60) != 0
    escapes = grid[escaped]
    grid[escaped] = np.arange(len(escapes), dtype=np.uint64)
    # The best selector for a word that begins at each place: from wide to narrow, later ones win.
    best = np.full((blocks, block), 15, np.uint8)
    # Narrow arrays for the comparisons: most ids need no more than 32 bits.
    small = grid.astype(np.uint32) if n and int(values.max()) < 1 << 32 else grid
    wide, over, fits = np.empty(grid.shape, bool), np.zeros((blocks, block + 1), np.int16), np.empty(grid.shape, bool)
    for selector in range(14, 0, -1):
        count, bits = int(COUNTS[selector]), int(BITS[selector])
        np.greater(small, small.dtype.type((1 << min(bits, small.itemsize * 8)) - 1), out=wide)
        if len(escapes):
            wide |= escaped
        np.cumsum(wide, axis=1, dtype=np.int16, out=over[:, 1:])
        # A word holds `count` values from a place on, or what is left of the block.
        cut = max(0, block - count)
        np.equal(over[:, count : count + cut], over[:, :cut], out=fits[:, :cut])
        np.equal(over[:, block:], over[:, cut:block], out=fits[:, cut:])
        if not fits.any():
            break
        best[fits] = selector
    best[escaped] = 0
    # Walk through all blocks side by side.
    at, live, starts = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        here = at[live]
        starts.append(live * block + here)
        at[live] = here + COUNTS[best[live, here]]
        live = live[at[live] < ends[live]]
    starts = np.sort(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
    chosen = best.reshape(-1)[starts].astype(np.uint64)
    words = chosen << np.uint64(60)
    flat = np.concatenate([grid.reshape(-1), np.zeros(block, np.uint64)])
    limit = (starts // block + 1) * block
    for selector in np.unique(chosen).astype(int):
        of = np.flatnonzero(chosen == selector)
        if BITS[selector]:
            payload = np.zeros(len(of), np.uint64)
            for i in range(COUNTS[selector]):
                place = starts[of] + i
                payload |= np.where(place < limit[of], flat[place], np.uint64(0)) << np.uint64(i * BITS[selector])
            words[of] |= payload
    offsets = np.searchsorted(starts, np.arange(blocks + 1) * block).astype("<u8")
    return HEADER.pack(MAGIC, block, n, len(escapes), len(words)) + offsets.tobytes() + escapes.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def decode(segment: bytes, first_block: int = 0, end_block: int | None = None) -> np.ndarray:
    """The values of a segment, or of some of its blocks."""
    magic, block, n, n_escapes, n_words = HEADER.unpack_from(segment)
    if magic != MAGIC:
        raise ValueError("not a segment of this format")
    blocks = -(-n // block)
    offsets = np.frombuffer(segment, "<u8", blocks + 1, HEADER.size).astype(np.int64)
    at = HEADER.size + 8 * (blocks + 1)
    escapes = np.frombuffer(segment, "<u8", n_escapes, at)
    words = np.frombuffer(segment, "<u8", n_words, at + 8 * n_escapes)
    end_block = blocks if end_block is None else min(end_block, blocks)
    if first_block >= end_block:
        return np.zeros(0, np.uint64)
    offsets = offsets[first_block : end_block + 1]
    words = words[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    total = max(0, min(n, end_block * block) - first_block * block)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    begins = np.cumsum(counts) - counts
    # A block's last word may stand for fewer values than its selector packs.
    of_block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    begins = begins - begins[offsets[:-1]][of_block] + of_block * block if len(words) else begins
    out = np.zeros(max(1, len(offsets)) * block + 240, np.uint64)
    for selector in np.unique(selectors)[::-1]:
        of = np.flatnonzero(selectors == selector)
        bits = int(BITS[selector])
        if bits:
            mask, limit = np.uint64((1 << bits) - 1), (of_block[of] + 1) * block
            for i in range(COUNTS[selector]):
                place, value = begins[of] + i, words[of] >> np.uint64(i * bits) & mask
                inside = place < limit
                out[place[inside]] = value[inside] if selector else escapes[value[inside].astype(np.int64)]
    return out[:total]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode docs (doc_id, text) and write their ids in ascending doc_id order; returns the files' table.

    The texts are range-partitioned by doc_id (by a hash of the text among equal ids, so that one id
    cannot fill a task) and encoded in order; a partition is a shard. A row of the files is a segment of
    whole documents: shard, first_id (its first id's place in the shard), doc_ids, lengths, n_ids and
    data, the Simple-8b bytes. Spark's committer writes them to the shared folder, so each task's output
    counts once however often it is tried. A task holds one segment.

    A null text is an empty one; a document always has at least its end id. Null doc_ids come first.
    Repeated rows are documents of their own, ordered by a hash of their text. Other columns are ignored.
    """
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("first_id", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)),
            T.StructField("lengths", T.ArrayType(T.LongType())),
            T.StructField("n_ids", T.LongType()),
            T.StructField("data", T.BinaryType()),
        ]
    )
    end = end_id.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        shard, first, held, kept, size = TaskContext.get().partitionId(), 0, [], [], 0
        encode_text = encoder(tokenizer).encode

        def segment() -> pa.RecordBatch:
            nonlocal first
            lengths = [len(x) // 4 for x in kept]
            n = sum(lengths)
            data = encode(np.frombuffer(b"".join(kept), "<u4"))
            row = [[shard], [first], [held], [lengths], [n], [data]]
            first += n
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                kept.append(encode_text(text.as_py()) + end)
                held.append(doc_id)
                size += len(kept[-1]) // 4
                if size >= segment_ids:
                    yield segment()
                    held, kept, size = [], [], 0
        if held:
            yield segment()

    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), tie)
    return materialize(ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie).mapInArrow(write, schema))


def read_token_files(files: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32, and ids if wanted.

    Only the shards' lengths come to the driver, one number for each file.
    """
    lengths = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    begins, total = {}, 0
    for shard, n in lengths:
        begins[shard] = total
        total += n
    doc_id = T.StructField("doc_id", files.schema["doc_ids"].dataType.elementType)
    numbers = [T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]
    schema = T.StructType([doc_id, *numbers, *[T.StructField("ids", T.ArrayType(T.LongType()))] * keep_ids])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, first, ids, lengths, _, data = (batch.column(i)[row] for i in range(6))
                values = decode(data.as_py())
                ends = np.cumsum(lengths.values.to_numpy())
                starts = ends - lengths.values.to_numpy()
                small = values.astype("<u4")
                crc = [zlib.crc32(small[a:b]) for a, b in zip(starts, ends, strict=True)]
                columns = [ids.values, pa.array(starts + first.as_py() + begins[shard.as_py()]), pa.array(ends - starts), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]), pa.int32()), pa.array(values.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return files.mapInArrow(read, schema)
