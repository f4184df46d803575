"""Best-fit packing of documents into training sequences.

Bounded-space online best-fit. Each task keeps a fixed number of open sequences. A bitset has one bit
for each free space from 1 to the capacity; the lowest set bit at or above a piece's length is the
open sequence that it fits best. If there is none, a new sequence opens, and if too many are open the
fullest one, the lowest set bit of all, closes. Pieces reach a task longest first, by Spark's
spillable sort, so that the short ones fill what the long ones leave.

A task's memory is its open sequences. Pieces are dealt out round-robin over so many tasks that each
fills hundreds of sequences; at most the open, unfilled end of a task is lost against one global
packing. The dealing is deterministic, so a lost task gives the same rows when it runs again.

Defined results: a null text is an empty one, and an empty document is one piece that holds only the
end id. Null and repeated doc_ids and repeated rows are documents of their own. An empty table gives
no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, shuffle_partitions
from .tokens import encoder

CAPACITY = 4096
OPEN_SEQUENCES = 1024
END_ID = 1
#: A task packs about so many full sequences, as long as there are partitions enough.
SEQUENCES_A_TASK = 512


class BestFit:
    """place(length) -> (sequence, offset), for lengths from 1 to capacity."""

    def __init__(self, capacity: int = CAPACITY, open_sequences: int = OPEN_SEQUENCES):
        self.capacity, self.most = capacity, open_sequences
        self.spaces = 0  # bit f is set if an open sequence has f free places
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        sequence = self.by_space[free].pop()
        if not self.by_space[free]:
            self.spaces &= ~(1 << free)
        self.open -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        if not 1 <= length <= self.capacity:
            raise ValueError(f"a piece of {length} ids in sequences of {self.capacity}")
        fitting = self.spaces >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if self.open >= self.most:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            self.by_space[left].append(sequence)
            self.spaces |= 1 << left
            self.open += 1
        return sequence, self.capacity - free


def _piece_schema(docs: DataFrame, keep_ids: bool, order: list[T.StructField]) -> T.StructType:
    fields = [
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        *order,
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    return T.StructType(fields + [T.StructField("ids", T.BinaryType())] * keep_ids)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, order: Sequence[Column] = ()) -> DataFrame:
    """One row for each piece: doc_id, the order columns as order_0, order_1, ..., piece, start, length, ids_crc32, and ids (binary) if wanted."""
    read = docs.select("doc_id", *(c.alias(f"order_{i}") for i, c in enumerate(order)), "text")
    kept = len(order) + 1
    schema = _piece_schema(docs, keep_ids, list(read.schema.fields[1:kept]))
    end = end_id.to_bytes(4, "little")
    width = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            source, columns = [], [[] for _ in schema.names[kept:]]
            for row, text in enumerate(batch.column(kept)):
                ids = encode(text.as_py()) + end
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    source.append(row)
                    for column, value in zip(columns, (at // width, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                        column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            rows = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:kept]), *arrays], names=schema.names)

    return read.mapInArrow(cut, schema)


def pack(cut: DataFrame, capacity: int = CAPACITY, open_sequences: int = OPEN_SEQUENCES) -> DataFrame:
    """Adds sequence_id and offset to rows of pieces(); cut is read twice, so give a written table.

    With order columns a task packs a stretch of that order, and sequence_id follows the stretches.
    """
    total = cut.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(shuffle_partitions(cut.sparkSession), round(total / capacity / SEQUENCES_A_TASK)))
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        bins = BestFit(capacity, open_sequences)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            sequence = pa.array([first + s for s, _ in placed], pa.int64())
            offset = pa.array([at for _, at in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sequence, offset], names=schema.names)

    by = [c for c in cut.columns if c.startswith("order_")]
    dealt = cut.repartitionByRange(tasks, *by) if by else cut.repartition(tasks)
    return dealt.sortWithinPartitions(F.desc("length"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")).mapInArrow(fill, schema)


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_sequences: int = OPEN_SEQUENCES, end_id: int = END_ID, keep_ids: bool = False, order: Sequence[Column] = ()) -> DataFrame:
    """Pack documents (doc_id, text): a row for each piece with its sequence and place.

    order: columns that tell the order of training. Documents then share a sequence only with others of their stretch of it,
    of about SEQUENCES_A_TASK sequences, and the columns come out as order_0, order_1, ...
    """
    return pack(materialize(pieces(docs, tokenizer, capacity, end_id, keep_ids, order)), capacity, open_sequences)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces packed with keep_ids: sequence_id, ids (binary), n_ids.

    A group is one sequence, so it is bounded by the capacity.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    return packed.groupBy("sequence_id").agg(ids.alias("ids"), F.sum("length").alias("n_ids"))
