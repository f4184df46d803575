"""Language-model scores by logistic context mixing over whole texts.

A document is the stream of its lower-cased words, each with a space, and an end; mixer.py predicts it bit by bit. The
logarithms of the bits add up to the probability of the token sequence. What the model knows comes from the training
documents only:

* Counts. Every byte of every training text is counted under every predictor's context, in one table of hashed lines.
  Tasks count apart and send slices of their tables, which are added up by slice. The code of bytes is by their ranks in
  the vocabulary, weighed with its counts.
* Weights and adaptive map, by deleted estimation: one fold of the training documents (TUNE_FOLD of FOLDS) is predicted
  from the counts of the other training folds. ROUNDS passes each sum up a Newton step of the gated weights, the last one
  the map too. The counts of that fold are in the final table like all others.

The table has a fixed number of cells (mixer.CELLS), which bounds memory and broadcasts; counts grow with the input, and so
does the tuning fold. All sums are of whole numbers, so scores do not depend on how rows are dealt to tasks.

The base score takes exact counts of words, by a map-side count and one shuffle by word. For scoring, the most frequent
words (at most TOP_WORDS, by a threshold that is found from a histogram of counts) are broadcast; all other words of texts
are shuffled to the counts. So no word is a hot key, and a task holds bounded tables only. Intermediate tables are written
to the shared folder.

Defined results: a null text is an empty one; an empty text has the end token only; repeated rows and null doc_ids are
documents of their own; words without a training count have c = 0; ties do not arise, as every row is scored by itself.
Without any training document N = V = 0 and every bit is predicted from the text alone. Only doc_id and text are used.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import mixer
from .common import fold, materialize, sliced

FOLDS, TEST_FOLD, TUNE_FOLD = 7, 2, 3
ROUNDS = 2
TOP_WORDS = 120_000
#: Cells of a slice of the table of counts.
SLICE = 1 << 14
#: A counting task takes so many input partitions, as it sends a whole table.
COUNT_TOGETHER = 2


def tokens_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words, split at space and U+0009 to U+000D, and the end token."""
    return [*text.lower().split(), mixer.END]


# --- the model ---------------------------------------------------------------------------------------------------


def planes(counts: np.ndarray) -> bytes:
    """Counts as their low bytes, then their second bytes, and so on; planes above the highest in use are left out."""
    split = np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    used = max(1, 4 - next((i for i in range(4) if split[3 - i].any()), 4))
    return split[:used].tobytes()


def unplanes(data: bytes, size: int = SLICE) -> np.ndarray:
    found = np.zeros(size, np.uint64)
    for i, plane in enumerate(np.frombuffer(data, np.uint8).reshape(-1, size)):
        found += plane.astype(np.uint64) << np.uint64(8 * i)
    return found


def _streams(column: pa.Array) -> list[bytes]:
    return [mixer.stream(x.as_py() or b"")[0] for x in column]


def byte_ranks(words: DataFrame) -> np.ndarray:
    """The code of each byte, by its frequency in the training texts, of a written table of their words (word, c)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(256, np.int64)
        for batch in batches:
            own, times = [w.encode() for w in batch.column(0).to_pylist()], batch.column(1).to_numpy()
            letters = np.frombuffer(b"".join(own), np.uint8)
            np.add.at(found, letters, np.repeat(times, [len(w) for w in own]))
            found[32] += sum(int(c) for w, c in zip(own, times, strict=True) if w != mixer.END)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(found, pa.int64())], names=["byte", "n"])

    frequency = np.zeros(256, object)
    for r in words.select("word", "c").mapInArrow(count, "byte int, n long").groupBy("byte").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
        frequency[r.byte] = int(r.n)
    return mixer.ranks(frequency)


def count_lines(texts: DataFrame, tuning: Column, codes: np.ndarray) -> DataFrame:
    """slice, known, counts: the slices of each task's table, apart for texts of the tuning fold and all others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in sliced(batches):
            if batch.num_rows:
                table = np.zeros(mixer.CELLS, np.uint32) if table is None else table
                mixer.count(table, _streams(batch.column(0)), codes)
        if table is not None:
            slices = table.reshape(-1, SLICE)
            used = np.flatnonzero(slices.any(axis=1))
            for at in range(0, len(used), 256):
                own = used[at : at + 256]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([planes(slices[i]) for i in own], pa.binary())], names=["slice", "counts"])

    cores = texts.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, texts.rdd.getNumPartitions() // COUNT_TOGETHER)
    made = [texts.where(tuning == of).select("text").coalesce(parts).mapInArrow(count, "slice int, counts binary").withColumn("tuning", F.lit(of)) for of in (False, True)]
    return made[0].unionByName(made[1])


def logit_slices(counted: DataFrame) -> DataFrame:
    """slice, known, full: the logits of slices by the counts without and with the tuning fold."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by slice, so a task holds one slice at a time.
        own, sums = -1, np.zeros((2, SLICE), np.uint64)

        def made() -> pa.RecordBatch:
            places = mixer.holds_places(own * SLICE)
            row = [[own], [mixer.logits(sums[0], places).tobytes()], [mixer.logits(sums[0] + sums[1], places).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["slice", "known", "full"])

        for batch in batches:
            for n, data, tuning in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if n != own:
                    if own >= 0:
                        yield made()
                    own = n
                    sums[:] = 0
                sums[int(tuning)] += unplanes(data.as_buffer())
        if own >= 0:
            yield made()

    return counted.repartition("slice").sortWithinPartitions("slice").mapInArrow(add, "slice int, known binary, full binary")


class Logits:
    """The table of logits, of a fixed size; compressed when it is sent, as a small corpus leaves most of it empty."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    def __getstate__(self) -> bytes:
        return zlib.compress(self.cells, 1)

    def __setstate__(self, data: bytes) -> None:
        self.cells = np.frombuffer(zlib.decompress(data), np.int8)

    @classmethod
    def read(cls, slices: DataFrame, column: str) -> Logits:
        """From one column of the written slices."""
        table = np.zeros(mixer.CELLS, np.int8).reshape(-1, SLICE)
        for r in slices.select("slice", column).toLocalIterator():
            table[r[0]] = np.frombuffer(r[1], np.int8)
        return cls(table.reshape(-1))


def train(docs: DataFrame, words: DataFrame) -> tuple[Logits, mixer.Mixer]:
    """The table of logits and the mixer to start texts with, from the training documents of docs (doc_id, text) and their words."""
    spark = docs.sparkSession
    number = fold(FOLDS)
    texts = docs.where(number != TEST_FOLD).select(F.col("text").cast("binary").alias("text"), (number == TUNE_FOLD).alias("tuning"))
    codes = byte_ranks(words)
    slices = materialize(logit_slices(count_lines(texts, F.col("tuning"), codes)))
    model = mixer.Mixer(codes)
    table = spark.sparkContext.broadcast(Logits.read(slices, "known"))
    sizes = ((mixer.GATES, mixer.INPUTS), (mixer.GATES, mixer.INPUTS, mixer.INPUTS), (mixer.MAP, 2))
    for _ in range(ROUNDS):
        weights = model.weights

        def sums(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            own, total = mixer.Mixer(codes, weights), None
            for batch in sliced(batches):
                made = own.gradients(table.value.cells, _streams(batch.column(0)))
                total = made if total is None else [a + b for a, b in zip(total, made, strict=True)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([x.reshape(-1) for x in total])], pa.list_(pa.int64()))], names=["sums"])

        found = texts.where("tuning").select("text").mapInArrow(sums, "sums array<long>").select(F.posexplode("sums"))
        flat = np.zeros(sum(int(np.prod(s)) for s in sizes))
        for r in found.groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("n")).collect():
            flat[r.pos] = float(r.n)
        slope, bend, seen = (x.reshape(s) for x, s in zip(np.split(flat, np.cumsum([int(np.prod(s)) for s in sizes])[:-1]), sizes, strict=True))
        model = mixer.Mixer(codes, model.stepped(slope, bend), seen)
    table.destroy()
    return Logits.read(slices, "full"), model


# --- the base ----------------------------------------------------------------------------------------------------


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and c, its count in the training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def take() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for text in batch.column(0):
                held.update(tokens_of(text.as_py() or b""))
                if len(held) > 150_000:
                    yield take()
        yield take()

    texts = docs.where(fold(FOLDS) != TEST_FOLD).select(F.col("text").cast("binary"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def frequent_words(words: DataFrame, most: int) -> dict[bytes, int]:
    """The words with the highest counts, at most so many; all words of a count are in it or none is."""
    level = F.floor(8 * F.log2("c")).cast("int")
    least, so_far = 1 << 62, 0
    for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("level")).collect():
        so_far += r.n
        if so_far > most:
            break
        least = r.least
    return {r.word.encode(): r.c for r in words.where(F.col("c") >= least).toLocalIterator()}


# --- scores ------------------------------------------------------------------------------------------------------


def score(docs: DataFrame, top_words: int = TOP_WORDS) -> DataFrame:
    """A row for each of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    words = materialize(vocabulary(docs))
    tokens, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    whole = tokens + distinct + 1
    table, model = train(docs, words)
    shared = spark.sparkContext.broadcast((table, model, frequent_words(words, top_words)))
    del table
    doc_id = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    fields = [("row", T.LongType()), ("bytes", T.LongType()), ("n_tokens", T.LongType()), ("k", T.LongType()), ("b", T.DoubleType()), ("score", T.DoubleType()), ("words", T.ArrayType(T.StringType())), ("counts", T.ArrayType(T.LongType()))]
    schema = T.StructType([doc_id, *(T.StructField(n, k) for n, k in fields)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        logits, own_model, counts = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in sliced(batches):
            columns: list[list] = [[] for _ in fields]
            streams = []
            for text in batch.column(1):
                raw = text.as_py() or b""
                own = tokens_of(raw)
                streams.append(b" ".join(own))
                base, known, rare = 0.0, 0, {}
                for w, n in Counter(own).items():
                    c = counts.get(w)
                    if c:
                        known += n
                        base += n * log10((c + 1) / whole)
                    else:
                        rare[w] = n
                values = (row, len(raw), len(own), known, base, 0.0, [w.decode() for w in rare], list(rare.values()))
                row += 1
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            columns[5] = own_model.score(logits.cells, streams).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

    read_docs = materialize(docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(read, schema))
    each = read_docs.select("row", F.explode(F.arrays_zip("words", "counts")).alias("z")).selectExpr("row", "z.words AS word", "z.counts AS n")
    c = F.coalesce("c", F.lit(0))
    joined = each.join(words, "word", "left").select("row", F.when(c > 0, F.col("n")).otherwise(0).alias("k"), (F.col("n") * F.log10((c + 1) / F.lit(float(whole)))).alias("b"))
    nothing = [F.lit(None).cast(k).alias(x) for x, k in (("doc_id", doc_id.dataType), ("bytes", "long"), ("n_tokens", "long"), ("score", "double"))]
    every = read_docs.select("row", "k", "b", "doc_id", "bytes", "n_tokens", "score").unionByName(joined.select("row", "k", "b", *nothing))
    kinds = [F.max("doc_id").alias("doc_id"), F.max("bytes").alias("bytes"), F.max("n_tokens").alias("n_tokens"), F.sum("k").alias("n_known"), F.sum("b").alias("base_score"), F.max("score").alias("score")]
    out = every.groupBy("row").agg(*kinds)
    bits = -F.col("score") * F.lit(1 / log10(2)) / F.greatest(F.lit(1), F.col("bytes"))
    return out.select("doc_id", (fold(FOLDS) == TEST_FOLD).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
