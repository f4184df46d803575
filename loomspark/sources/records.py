"""Records from JSON files of any shape, cut in parallel: JSON lines, values over several lines, arrays on one line.

A file is read in Spark's splits. Where a split begins inside a value or a string, its text says nothing by itself, so every
split is first summed up as a function of the state before it, for both states that matter (outside of strings and inside one):
the state after it, and its brackets with all pairs taken out. These functions compose (join the brackets and take pairs out
again), so one row a split, folded in order for each file, gives the state that each split begins in. With that, a second
pass cuts each split's values on its own; only pieces of values that cross an edge meet again, in order, for each file.

Splits end at a separator, for which a line's end, a comma or a colon is taken, whichever leaves short pieces: a file
on one line is read at its commas. So no file is ever one row, and a value is in memory only if it is a record itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import keep, ship

#: Separators in the order they are tried, and the longest piece between two for which no other is tried.
SEPARATORS = ("\n", ",", ":")
PIECE = 1 << 22
#: Up to so many splits that begin inside something are told to all tasks; more are joined by a shuffle.
TOLD = 200_000

_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*+"', re.S)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*+"', re.S)
_INSIDE = re.compile(r'["\[\]{}]')
#: What stands between records, and a record that is no string, array or object; the last colon of a file read at its colons is no text.
_BETWEEN = {s: (re.compile(rf"[\s,\ufeff{s}]*"), re.compile(rf'[^\s,\[\]{{}}"\ufeff{s}]+')) for s in SEPARATORS}
_PAIRS = {"[": "]", "{": "}"}


def without_pairs(brackets: str) -> str:
    """Brackets with matching pairs taken out: closing ones that want a start, then opening ones that want an end, else broken."""
    before = None
    while before != brackets:
        before, brackets = brackets, brackets.replace("[]", "").replace("{}", "")
    return brackets


class Summary:
    """What a text does to the state before it, for a start outside (0) and inside (1) of a string."""

    def __init__(self) -> None:
        self.brackets, self.inside = ["", ""], [False, True]

    def feed(self, text: str) -> None:
        for start in (0, 1):
            own, inside = text, self.inside[start]
            if inside:
                end = _REST_OF_STRING.match(own)
                if not end:
                    continue
                own, inside = own[end.end() :], False
            bare = _STRING.sub("", own)
            at = bare.find('"')
            if at >= 0:
                bare, inside = bare[:at], True
            self.brackets[start] = without_pairs(self.brackets[start] + re.sub(r"[^\[\]{}]+", "", bare))
            self.inside[start] = inside


class Cutter:
    """Values of a text that comes in pieces, from a state: the open brackets, and whether a string is open.

    A record is a value of its own or an element of an array that is one. `kind` is 0 for whole records, 1 for the end of a value
    that began before this text, 2 for one that goes on after it, 3 for what is neither begun nor ended here.
    """

    def __init__(self, stack: str = "", inside: bool = False, separator: str = "\n"):
        self.stack, self.inside = stack, inside
        self.skip, self.scalar = _BETWEEN[separator]
        self.continued = self.open = inside or stack not in ("", "[")
        self.parts: list[str] = []
        self.broken = False

    def _done(self, text: str) -> tuple[int, str]:
        found = (1 if self.continued else 0, "".join([*self.parts, text]))
        self.parts, self.open, self.continued = [], False, False
        return found

    def feed(self, text: str) -> Iterator[tuple[int, str]]:
        at = begin = 0
        while at < len(text) and not self.broken:
            if self.inside:
                end = _REST_OF_STRING.match(text, at)
                if not end:
                    break
                at, self.inside = end.end(), False
                if self.stack in ("", "["):
                    yield self._done(text[begin:at])
            elif self.open:
                found = _INSIDE.search(text, at)
                if not found:
                    break
                at, sign = found.end(), found[0]
                if sign == '"':
                    self.inside = True
                elif sign in _PAIRS:
                    self.stack += sign
                elif _PAIRS[self.stack[-1]] != sign:
                    self.broken = True
                else:
                    self.stack = self.stack[:-1]
                    if self.stack in ("", "["):
                        yield self._done(text[begin:at])
            else:
                begin = at = self.skip.match(text, at).end()
                if at == len(text):
                    break
                sign = text[at]
                if sign == "[" and not self.stack:
                    self.stack, at = "[", at + 1
                elif sign in _PAIRS:
                    self.stack, self.open, at = self.stack + sign, True, at + 1
                elif sign == "]" and self.stack:
                    self.stack, at = "", at + 1
                elif sign in "]}:":
                    self.broken = True
                elif sign == '"':
                    self.inside = self.open = True
                    at += 1
                else:
                    end = self.scalar.match(text, at)
                    at = end.end()
                    yield self._done(end[0])
        if self.open and not self.broken:
            self.parts.append(text[begin:])

    def rest(self) -> list[tuple[int, str]]:
        if not self.open or self.broken:
            return []
        return [(3 if self.continued else 2, "".join(self.parts))]


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    text = ship(spark).read.option("lineSep", separator).text(path)
    return text.select(F.make_valid_utf8("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _splits(batches: Iterator[pa.RecordBatch], separator: str) -> Iterator[tuple[tuple, str]]:
    """((file, start), text) of stretches of one split; each piece gets its separator back."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        at, n = 0, batch.num_rows
        while at < n:
            key, end = (columns[1][at], columns[2][at]), at
            while end < n and (columns[1][end], columns[2][end]) == key:
                end += 1
            yield key, separator.join(columns[0][at:end]) + separator
            at = end


def summaries(pieces: DataFrame, separator: str) -> DataFrame:
    """file, start, the longest piece, and what each split does to the two states."""
    schema = "file string, start long, longest long, brackets array<string>, inside array<boolean>"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for key, text in _splits(batches, separator):
            own = found.setdefault(key, [0, Summary()])
            own[0] = max(own[0], max(map(len, text.split(separator))))
            own[1].feed(text)
        columns = list(zip(*((f, s, longest, x.brackets, x.inside) for (f, s), (longest, x) in found.items()), strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "start", "longest", "brackets", "inside"])

    return pieces.mapInArrow(add, schema)


def states(summed: DataFrame) -> DataFrame:
    """file, start, and the stack and inside that each split begins with; a row with a null start has the end of the file.

    Splits whose state before cannot be (a bracket was closed that none had opened) are left out.
    """
    schema = "file string, start long, stack string, inside boolean"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, stack, inside, out = None, "", False, []
        for batch in batches:
            for own, start, brackets, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != file:
                    if file is not None:
                        out.append((file, None, stack, inside))
                    file, stack, inside = own, "", False
                if not set(stack) & set("]}"):
                    out.append((file, start, stack, inside))
                stack, inside = without_pairs(stack + brackets[inside]), after[inside]
        if file is not None:
            out.append((file, None, stack, inside))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["file", "start", "stack", "inside"])

    ordered = summed.select("file", "start", "brackets", "inside").repartition("file").sortWithinPartitions("file", "start")
    return ordered.mapInArrow(fold, schema)


def _cut(known: DataFrame, separator: str) -> DataFrame:
    """file, start, number, kind and text of the values of splits (value, file, start, stack, inside)."""
    names = ["file", "start", "number", "kind", "text"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cutter, number = None, None, 0

        def rows(found) -> Iterator[pa.RecordBatch]:
            nonlocal number
            out, size = [], 0
            for kind, text in found:
                out.append((*key, number, kind, text))
                number += 1
                size += len(text)
                if len(out) == 1000 or size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            at = 0
            for own, text in _splits([batch], separator):
                if own != key:
                    if cutter:
                        yield from rows(cutter.rest())
                    key, number = own, 0
                    cutter = Cutter(batch.column(3)[at].as_py() or "", bool(batch.column(4)[at].as_py()), separator)
                yield from rows(cutter.feed(text))
                while at < batch.num_rows and (batch.column(1)[at].as_py(), batch.column(2)[at].as_py()) == own:
                    at += 1
        if cutter:
            yield from rows(cutter.rest())

    return known.mapInArrow(cut, "file string, start long, number long, kind int, text string")


def _joined(crossing: DataFrame) -> DataFrame:
    """Whole values of the pieces of those that cross edges, in the order of their file."""
    names = ["file", "start", "number", "text"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, parts = None, []
        for batch in batches:
            for file, start, number, kind, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 2:
                    begun, parts = (file, start, number), [text]
                elif begun and begun[0] == file:
                    parts.append(text)
                    if kind == 1:
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*begun, "".join(parts)), kinds, strict=True)], names=names)
                        begun, parts = None, []

    ordered = crossing.repartition("file").sortWithinPartitions("file", "start", "number")
    return ordered.mapInArrow(join, "file string, start long, number long, text string")


def _cuts_all(spark: SparkSession, path: str, separator: str) -> bool:
    """Whether no piece of the files is much longer than PIECE: Spark's reader passes over longer lines, and their bytes are missing.

    So a file on one line is not given to Python, or held by a reader, as one row.
    """
    lines = ship(spark).read.option("lineSep", separator).option("mapreduce.input.linerecordreader.line.maxlength", str(2 * PIECE)).text(path)
    own = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.octet_length("value").alias("n"))
    files = own.groupBy("file").agg(F.max("size").alias("size"), F.sum(F.col("n") + 1).alias("read"))
    read = files.agg(F.sum("size"), F.sum(F.greatest(F.lit(0), F.col("size") - F.col("read"))), F.count("*")).first()
    # A file of which no line is left has no row at all.
    empty = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0").join(files, F.col("path") == F.col("file"), "left_anti")
    return (read[1] or 0) < PIECE and empty.isEmpty()


def _summed(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The separator to read with, and the summaries with it."""
    best, refused = None, None
    for separator in [s for s in SEPARATORS if _cuts_all(spark, path, s)] or SEPARATORS:
        try:
            summed = keep(summaries(_pieces(spark, path, separator), separator))
        except PySparkException as e:  # a piece of more than 2 GB; with another separator it may be shorter
            refused = e
            continue
        longest = summed.agg(F.max("longest")).first()[0] or 0
        if best is None or longest < best[0]:
            best = (longest, separator, summed)
        if longest <= PIECE:
            break
    if best is None:
        raise refused
    return best[1:]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """record (JSON text), error, file, and its order in the file (start, number): one row for each value of JSON files.

    Elements of an array that is a value by itself are the records; other values are their own. Digits and spaces stay as they
    are written. A value that is no JSON, and a file whose brackets or strings do not end, are rows with an error and no
    record; what comes before the fault is read. An empty file has no rows.
    """
    separator, summed = _summed(spark, path)
    known = keep(states(summed))
    pieces = _pieces(spark, path, separator)
    told = known.where("start IS NOT NULL")
    if told.count() <= TOLD:
        begun = pieces.join(F.broadcast(told), ["file", "start"]).select("value", "file", "start", "stack", "inside")
    else:
        numbered = pieces.withColumn("row", F.monotonically_increasing_id())
        begun = numbered.join(told, ["file", "start"]).repartition("file", "start").sortWithinPartitions("file", "start", "row").select("value", "file", "start", "stack", "inside")
    values = keep(_cut(begun, separator))
    whole = values.where("kind = 0").select("file", "start", "number", "text").unionByName(_joined(values.where("kind > 0")))
    good = F.expr("try_parse_json(text)").isNotNull() & ~F.trim("text").isin("NaN", "Infinity", "-Infinity")
    records = whole.select(F.when(good, F.col("text")).alias("record"), F.when(~good, F.lit("no JSON value")).alias("error"), "file", "start", "number")
    # At the end nothing is open, or only an array's own bracket was forgotten, which takes no value with it.
    faulty = known.where("start IS NULL AND (inside OR stack <> '')")
    ends = faulty.select(F.lit(None).cast("string").alias("record"), F.lit("brackets or strings do not end").alias("error"), "file", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("number"))
    return records.unionByName(ends)
