"""Ranked search with a bit-sliced impact index.

The index holds, for each block of up to BLOCK documents and each term, the term's impacts on the block's documents (weight times
saturated count, whole numbers) as bitmaps: slice i has a bit for each document whose impact has bit i. A score is a sum of
impacts, so the slices of an item's terms are added by bitwise carry arithmetic, which adds 64 documents with every
operation on a word, and the k best of a block are found from the sum's most significant slice down: documents with the bit are in if they are
no more than k, else the others are out; what is left at the end has equal scores, and the smaller doc_ids are taken.

A term with documents in few of the block's words (of 64 documents each) has its impacts stored as a list and gets
its slices, of these words only, when it is read; all others are stored as slices. Both are added alike.

Documents are read once: counts of the terms that the items ask for are written, with every document's length; totals, document
frequencies and blocks come from that table. A block is a stretch of one partition, so nothing is shuffled to make it. To search, a
block's terms go to one task, one after the other, each added to the sums of the items that hold it; a task returns k
rows for an item from all its blocks, and Spark's window keeps the k best of them. Items are handled in groups of at most
GROUP_ITEMS, which bounds what is broadcast (the group's terms) and a task's sums; many items are many passes over the documents.

Defined results: a null text has no terms; documents without terms do not count; items without terms have no rows; of equal scores
the smaller doc_id is first, nulls last; repeated doc_ids and item_ids are rows of their own; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, shuffle_partitions

K = 20
BLOCK = 1 << 16
#: A block also ends at so many postings.
POSTINGS = 1 << 22
GROUP_ITEMS = 256
#: Terms of a group of items: a larger group is cut into more. An item of more different terms is a group of its own.
GROUP_TERMS = 1 << 18
#: A term's list becomes stored slices where it has so many documents for each of its words on average.
DENSE = 6
#: Letters, digits and all but ASCII are terms; A-Z count as a-z.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


# ---- slices


def to_slices(places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, slices) of values at ascending places: the words that hold any, and for each bit of the values a row over them."""
    words, starts = np.unique(places >> 6, return_index=True)
    bits = np.uint64(1) << (places & 63).astype(np.uint64)
    height = int(values.max()).bit_length()
    rows = [np.bitwise_or.reduceat(np.where(values >> np.int64(i) & 1, bits, np.uint64(0)), starts) for i in range(height)]
    return words, np.array(rows, np.uint64).reshape(height, len(words))


class Sums:
    """Slices of the sums of all documents of a block, for one item."""

    def __init__(self, words: int):
        self.slices = np.zeros((0, words), np.uint64)

    def add(self, words: np.ndarray, slices: np.ndarray, shift: int = 0) -> None:
        """Add values, times 2 ** shift, by a ripple of carries."""
        dense = len(words) == self.slices.shape[1]
        need = shift + len(slices) + 1
        if len(self.slices) < need:
            self.slices = np.concatenate([self.slices, np.zeros((need - len(self.slices), self.slices.shape[1]), np.uint64)])
        carry = np.zeros(len(words), np.uint64)
        at = shift
        while at < shift + len(slices) or carry.any():
            if at == len(self.slices):
                self.slices = np.concatenate([self.slices, np.zeros((1, self.slices.shape[1]), np.uint64)])
            own = self.slices[at] if dense else self.slices[at][words]
            if at < shift + len(slices):
                added = slices[at - shift]
                half = own ^ added
                total, carry = half ^ carry, own & added | half & carry
            else:
                total, carry = own ^ carry, own & carry
            if dense:
                self.slices[at] = total
            else:
                self.slices[at][words] = total
            at += 1

    def top(self, k: int, least: int = 0) -> list[tuple[int, int]]:
        """(place, score) of the k best with scores above 0, those of equal scores by place. least: below it nothing is wanted."""
        if not len(self.slices):
            return []
        left = np.bitwise_or.reduce(self.slices, axis=0)
        sure = np.zeros_like(left)
        for row in self.slices[::-1]:
            with_bit = left & row
            tried = sure | with_bit
            n = int(np.bitwise_count(tried).sum())
            if n > k:
                left = with_bit
            else:
                sure, left = tried, left & ~row
                if n == k:
                    left[:] = 0
                    break
        places = _places(sure)
        places = np.concatenate([places, _places(left)[: k - len(places)]])
        scores = np.zeros(len(places), object)
        for i, row in enumerate(self.slices):
            scores += (row[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)).astype(object) << i
        found = [(int(p), int(s)) for p, s in zip(places, scores, strict=True) if s >= least]
        return sorted(found, key=lambda x: (-x[1], x[0]))


def _places(bitmap: np.ndarray) -> np.ndarray:
    """The places of the bits that are set."""
    return np.flatnonzero(np.unpackbits(bitmap.astype("<u8").view(np.uint8), bitorder="little"))


# ---- the index


def impact(tf: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """The saturated count of tf in documents of n terms, in 64-bit integers."""
    m = 75 + (25 * n * docs) // words if int(n.max(initial=0)) * docs < 2**58 else 75 + np.array([25 * int(x) * docs // words for x in n])
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (its terms with repeats), and terms and tf of those in the vocabulary, of every document with a term."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.LongType()))])
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = known.value
        for batch in batches:
            keep, sizes, ends, terms, tfs = [], [], [0], [], []
            for row, text in enumerate(batch.column(1)):
                found = terms_of(text.as_py())
                if not found:
                    continue
                keep.append(row)
                sizes.append(len(found))
                for number, tf in Counter(map(numbers.get, found)).items():
                    if number is not None:
                        terms.append(number)
                        tfs.append(tf)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(count, schema)


def frequencies(counts: DataFrame, terms: int) -> DataFrame:
    """term, df over a table of counts, each task's documents added up first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df[held])], names=["term", "df"])

    return counts.select("terms").mapInArrow(add, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


INDEX = "block long, term int, docs int, places binary, impacts binary"


def build_index(counts: DataFrame, weights: dict[int, int], docs: int, words: int, block: int = BLOCK) -> DataFrame:
    """A row for each block and term; term -1 has the block's doc_ids. docs and words: totals of the table that counts came from.

    places: 32-bit numbers of words (stored slices) or of documents (a list); impacts: the slices as 64-bit words, one
    slice after the other, or 64-bit impacts.
    """
    names = [f.split()[0] for f in INDEX.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    known = counts.sparkSession.sparkContext.broadcast(weights)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_term = np.zeros(1 + max(known.value, default=0), np.int64)
        for t, w in known.value.items():
            by_term[t] = w
        number, held, size, postings = TaskContext.get().partitionId() << 32, [], 0, 0

        def made() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([b.column(0).fill_null(0).to_numpy() for b in held])
            missing = np.concatenate([b.column(0).is_null().to_numpy(zero_copy_only=False) for b in held])
            order = np.lexsort((ids, missing))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            n = np.concatenate([b.column(1).to_numpy() for b in held])
            terms = np.concatenate([b.column(2).flatten().to_numpy() for b in held])
            tf = np.concatenate([b.column(3).flatten().to_numpy() for b in held])
            lengths = np.concatenate([b.column(2).value_lengths().to_numpy() for b in held])
            row = np.repeat(np.arange(len(n)), lengths)
            values = by_term[terms] * impact(tf, n[row], docs, words)
            keep = values > 0
            terms, values, at = terms[keep], values[keep], place[row[keep]]
            by = np.lexsort((at, terms))
            terms, values, at = terms[by], values[by], at[by]
            marks = missing[order].astype(np.uint8)
            rows = [(number, -1, len(order), marks.tobytes(), ids[order].tobytes())]
            bounds = np.flatnonzero(np.diff(terms, prepend=-1, append=-2))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                places, impacts = at[a:b], values[a:b]
                if b - a >= DENSE * len(np.unique(places >> 6)):
                    own, grid = to_slices(places, impacts)
                    rows.append((number, int(terms[a]), 0, own.astype(np.int32).tobytes(), grid.tobytes()))
                else:
                    rows.append((number, int(terms[a]), b - a, places.astype(np.int32).tobytes(), impacts.tobytes()))
                if len(rows) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for whole in batches:
            at = 0
            while at < whole.num_rows:
                batch = whole.slice(at, block - size)
                at += batch.num_rows
                held.append(batch)
                size += batch.num_rows
                postings += len(batch.column(2).flatten())
                if size == block or postings >= POSTINGS:
                    yield from made()
                    number, held, size, postings = number + 1, [], 0, 0
        if held:
            yield from made()

    return counts.select(F.col("doc_id").cast("long").alias("doc_id"), "n", "terms", "tf").mapInArrow(cut, INDEX)


# ---- searching


def best_of_blocks(index: DataFrame, asked: dict[int, list[tuple[int, int]]], k: int) -> DataFrame:
    """item, doc_id, score: each task's k best for each item. asked: for a term, the items that hold it and how often."""
    schema = "item int, doc_id long, score long"
    known = index.sparkSession.sparkContext.broadcast(asked)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value
        best: dict[int, list[tuple[int, bool, int]]] = {}  # -score, whether the id is null, the id
        sums: dict[int, Sums] = {}
        now, ids, nulls = None, np.zeros(0, np.int64), np.zeros(0, np.uint8)

        def close() -> None:
            for item, total in sums.items():
                kept = best.setdefault(item, [])
                least = -kept[-1][0] if len(kept) == k else 1
                found = [(-score, bool(nulls[place]), int(ids[place])) for place, score in total.top(k, least)]
                best[item] = sorted(kept + found)[:k]

        for batch in batches:
            for block, term, docs, places, impacts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    close()
                    now, sums = block, {}
                if term < 0:
                    ids, nulls = np.frombuffer(impacts, np.int64), np.frombuffer(places, np.uint8)
                    continue
                holders = wanted.get(term)
                if not holders:
                    continue
                own = np.frombuffer(places, np.int32).astype(np.int64)
                own, grid = to_slices(own, np.frombuffer(impacts, np.int64)) if docs else (own, np.frombuffer(impacts, np.uint64).reshape(-1, len(own)))
                for item, repeats in holders:
                    total = sums.get(item) or sums.setdefault(item, Sums(-(-len(ids) // 64)))
                    for shift in range(repeats.bit_length()):
                        if repeats >> shift & 1:
                            total.add(own, grid, shift)
        close()
        rows = [(item, None if null else doc, -score) for item, kept in best.items() for score, null, doc in kept]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"])

    dealt = index.repartition(shuffle_partitions(index.sparkSession), "block").sortWithinPartitions("block", "term")
    return dealt.mapInArrow(find, schema)


def _groups(items: DataFrame) -> Iterator[list[tuple[int, Counter]]]:
    """Items with their terms, a group after the other; row numbers tell them apart."""
    group: list[tuple[int, Counter]] = []
    size = 0
    for row in items.select("row", F.col("text").cast("string").cast("binary").alias("text")).toLocalIterator():
        found = Counter(terms_of(row.text))
        if not found:
            continue
        if group and (len(group) == GROUP_ITEMS or size + len(found) > GROUP_TERMS):
            yield group
            group, size = [], 0
        group.append((row.row, found))
        size += len(found)
    if group:
        yield group


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k highest-scoring documents of docs for each row of items."""
    numbered = materialize(items.select("item_id", "text").withColumn("row", F.monotonically_increasing_id()))
    parts = []
    for group in _groups(numbered):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, found in group for t in found}))}
        counts = materialize(counted(docs, vocabulary), codec="zstd")
        total, words = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total:
            continue
        weights = {r.term: weight(r.df, total) for r in frequencies(counts, len(vocabulary)).collect()}  # at most GROUP_TERMS rows
        index = materialize(build_index(counts, weights, total, words, block), codec="zstd")
        asked: dict[int, list[tuple[int, int]]] = {}
        for i, (_, found) in enumerate(group):
            for t, q in found.items():
                asked.setdefault(vocabulary[t], []).append((i, q))
        rows = F.element_at(F.array(*(F.lit(r) for r, _ in group)), F.col("item") + 1)
        parts.append(best_of_blocks(index, asked, k).select(rows.alias("row"), "doc_id", "score"))
    if not parts:
        return numbered.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(numbered.select("row", "item_id"), "row").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
