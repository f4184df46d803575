"""Repair of the structure of conversations by weighted finite-state composition.

Three machines are composed: an acceptor of the turns of a conversation, one symbol a row (its role's initial and its
fault); an edit transducer that keeps (K), reroles (R) or deletes (D) a turn or inserts an empty one (I); and an acceptor of
the roles' grammar, `(s?(ua)+)?`. The composed machine is never built: states (rows read, grammar state) are made as
the search meets them, in topological order. Weights are pairs (cost, labels of the path), compared in this order, so the
best path is the cheapest edit and, of the cheapest, the one whose labels come first in ASCII. Of two paths with one cost
into one state neither's labels begin the other's (what is longer has more inserts, which cost), so weights are a semiring
and stretches of rows can be composed on their own: a stretch is a matrix of weights from each grammar state to each.

Conversations of up to LONG_ROWS rows and LONG_BYTES of text are read whole, one after the other, from partitions by
conversation. Of longer ones, no task holds all rows: they are range-partitioned by their order, cut into blocks of BLOCK
rows, each block becomes a matrix in a task of its own, one row a block is multiplied in order, and the edits go back to
their rows by a join. Only what is one value of the result, the audit and the SHA-256 (which is sequential by its
definition), passes one task, the texts as a stream.

Defined results: a null role or text is one space; a null turn comes before all others; rows of one turn are ordered by
role and text; rows with a null conv_id are one conversation; other roles than system, user and assistant count by
their first letter; an empty role has no initial and is never legal. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, materialize, shuffle_partitions

#: The grammar of role initials: arcs by state, and the states in which a conversation may end.
ARCS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINALS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Longer conversations are split.
LONG_ROWS = 20_000
LONG_BYTES = 1 << 24
BLOCK = 4096
#: Up to so many keys of long conversations are sent to all tasks; more are joined by a shuffle.
BROADCAST_KEYS = 100_000
#: Faults: blank and duplicate turns have to go.
FINE, BLANK, DUPLICATE, CUT = ".bdt"

Weights = dict[int, tuple[int, str]]


def _better(into: Weights, state: int, cost: int, labels: str) -> bool:
    if state in into and into[state] <= (cost, labels):
        return False
    into[state] = (cost, labels)
    return True


def inserted(weights: Weights) -> Weights:
    """weights with inserts added: a second visit of a state never pays, so paths have fewer inserts than states."""
    best, front = dict(weights), weights
    for _ in range(len(ARCS) - 1):
        after: Weights = {}
        for state, (cost, labels) in front.items():
            for role in ROLES:
                if role in ARCS[state] and _better(best, ARCS[state][role], cost + INSERT, labels + "I"):
                    after[ARCS[state][role]] = best[ARCS[state][role]]
        front = after
    return best


def read(weights: Weights, initial: str, fault: str) -> Weights:
    """weights after one more row: every arc of the edit transducer that the grammar can follow."""
    after: Weights = {}
    extra = TRUNCATED if fault == CUT else 0
    for state, (cost, labels) in weights.items():
        _better(after, state, cost + DELETE, labels + "D")
        if fault in (BLANK, DUPLICATE):
            continue
        if initial in ARCS[state]:
            _better(after, ARCS[state][initial], cost + KEEP + extra, labels + "K")
        for role in ROLES:
            if role in ARCS[state]:
                _better(after, ARCS[state][role], cost + REROLE + extra, labels + "R")
    return after


def stretch(symbols: str, start: int = 0) -> Weights:
    """The weights from a grammar state over rows, two letters (initial, fault) a row."""
    weights: Weights = {start: (0, "")}
    for at in range(0, len(symbols), 2):
        weights = read(inserted(weights), symbols[at], symbols[at + 1])
    return weights


def times(weights: Weights, matrix: dict[int, Weights]) -> Weights:
    after: Weights = {}
    for state, (cost, labels) in weights.items():
        for to, (more, rest) in matrix.get(state, {}).items():
            _better(after, to, cost + more, labels + rest)
    return after


def finished(weights: Weights) -> tuple[int, str]:
    """The best (cost, labels) of all paths into a final state."""
    ends = inserted(weights)
    return min(ends[s] for s in FINALS if s in ends)


@lru_cache(1 << 14)
def _cheapest(symbols: str) -> tuple[int, str]:
    return finished(stretch(symbols))


def cheapest(symbols: str) -> tuple[int, str]:
    if len(symbols) <= 128:
        return _cheapest(symbols)
    weights: Weights = {0: (0, "")}
    for at in range(0, len(symbols), 1024):  # short labels within a stretch, long ones only between stretches
        part = symbols[at : at + 1024]
        weights = times(weights, {s: stretch(part, s) for s in weights})
    return finished(weights)


def edit(state: int, labels: str, role: str, text: str) -> tuple[int, list[tuple[str, str]]]:
    """The grammar state after a row's labels, and the turns they leave of it."""
    turns: list[tuple[str, str]] = []
    for label in labels:
        if label == "D":
            continue
        if label == "K":
            turns.append((role, text))
            state = ARCS[state][role[0]]
            continue
        initial = next(r for r in ROLES if r in ARCS[state])
        turns.append((ROLES[initial], "" if label == "I" else text))
        state = ARCS[state][initial]
    return state, turns


def by_row(labels: str, rows: int) -> tuple[list[str], str]:
    """The labels of each of the next rows, inserts with the row after them, and what is left."""
    found, at = [], 0
    for _ in range(rows):
        end = at
        while labels[end] == "I":
            end += 1
        found.append(labels[at : end + 1])
        at = end + 1
    return found, labels[at:]


def illegal_pairs(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


# ---- rows as Spark columns


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped) of every row, damaged by a hash of `conv_id:turn`."""
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    hit = F.crc32(named.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    damaged = F.when(hit <= 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", F.when(hit == 4, "user").otherwise(role).alias("role"), damaged.alias("text"), copies.alias("copies"))


def _prepared(rows: DataFrame) -> DataFrame:
    copies = F.col("copies").cast("int") if "copies" in rows.columns else F.lit(1)
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(_key().alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def _initial(role: Column) -> Column:
    first = F.left(role, F.lit(1))
    return F.when(first.isin("s", "u", "a"), first).otherwise("?")


def _faults(text: Column) -> tuple[Column, Column]:
    """blank, cut off: by the text alone."""
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return ~F.regexp_like(text, F.lit(WORD)), ~last.isin(".", "!", "?")


def _gaps(least: int | None, most: int | None, distinct: int) -> int:
    return 0 if least is None else min(most - least + 1 - distinct, 2**63 - 1)


def _summary(conv_id: T.DataType) -> T.StructType:
    longs = [T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return T.StructType([T.StructField("conv_id", conv_id), *longs, T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])


def _turns(conv_id: T.DataType) -> T.StructType:
    fields = [T.StructField("conv_id", conv_id), T.StructField("position", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
    return T.StructType(fields)


class _Conversation:
    """The rows of one conversation, in order, as they come."""

    def __init__(self, key: str, conv_id: object):
        self.key, self.conv_id = key, conv_id
        self.rows: list[tuple[str, str]] = []
        self.seen: set[tuple[str, str]] = set()
        self.symbols: list[str] = []
        self.turns: set[int] = set()

    def take(self, turn: int | None, role: str, text: str, copies: int, initial: str, blank: bool, cut: bool) -> None:
        for _ in range(copies):
            fault = BLANK if blank else DUPLICATE if (role, text) in self.seen else CUT if cut else FINE
            self.seen.add((role, text))
            self.rows.append((role, text))
            self.symbols += (initial, fault)
        if copies and turn is not None:
            self.turns.add(turn)

    def repaired(self) -> tuple[str, int, str, list[tuple[str, str]]]:
        symbols = "".join(self.symbols)
        cost, audit = cheapest(symbols)
        parts, rest = by_row(audit, len(self.rows))
        state, turns = 0, []
        for labels, (role, text) in zip(parts, self.rows, strict=True):
            state, more = edit(state, labels, role, text)
            turns += more
        return symbols, cost, audit, turns + edit(state, rest, "", "")[1]

    def summary(self) -> list[tuple]:
        symbols, cost, audit, turns = self.repaired()
        faults = symbols[1::2]
        gaps = _gaps(min(self.turns, default=None), max(self.turns, default=None), len(self.turns))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        return [(self.conv_id, gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, CUT)), illegal_pairs(symbols[::2]), cost, audit, digest)]

    def result(self) -> list[tuple]:
        return [(self.conv_id, i, r, t) for i, (r, t) in enumerate(self.repaired()[3])]


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)


def _short(rows: DataFrame, digest: bool) -> DataFrame:
    """Conversations that fit a task, read whole."""
    from pyspark.sql.pandas.types import to_arrow_schema

    blank, cut = _faults(F.col("text"))
    order = ["key", F.col("turn").asc_nulls_first(), "role", "text"]
    sorted_rows = rows.repartition("key").sortWithinPartitions(*order)
    sorted_rows = sorted_rows.select("key", "conv_id", "turn", "role", "text", "copies", _initial(F.col("role")).alias("initial"), blank.alias("blank"), cut.alias("cut"))
    schema = (_summary if digest else _turns)(rows.schema["conv_id"].dataType)
    fields = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        for batch in batches:
            out: list[tuple] = []
            for key, conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or key != now.key:
                    out += (now.summary() if digest else now.result()) if now else []
                    now = _Conversation(key, conv_id)
                now.take(*row)
            yield _batch(out, fields)
        if now:
            yield _batch(now.summary() if digest else now.result(), fields)

    return sorted_rows.mapInArrow(fold, schema)


# ---- long conversations, in blocks


def _matrices(blocks: DataFrame) -> DataFrame:
    """Every block's symbols as a matrix: its cells by from, to, cost, labels."""
    schema = "key string, first long, symbols string, cells array<struct<start:int,stop:int,cost:long,labels:string>>"
    cell = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("labels", pa.string())]))
    fields = pa.schema([("key", pa.string()), ("first", pa.int64()), ("symbols", pa.string()), ("cells", cell)])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, first, symbols in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cells = [{"start": s, "stop": t, "cost": c, "labels": x} for s in ARCS for t, (c, x) in stretch(symbols, s).items()]
                yield _batch([(key, first, symbols, cells)], fields)

    return blocks.select("key", "first", "symbols").mapInArrow(multiply, schema)


def _moved(state: int, labels: str, initial: str) -> int:
    for label in labels:
        if label != "D":
            state = ARCS[state][initial if label == "K" else next(r for r in ROLES if r in ARCS[state])]
    return state


def _paths(matrices: DataFrame) -> DataFrame:
    """For each conversation one row with counts, cost and audit, and for each of its blocks one with its rows' labels and states."""
    longs = ("blank", "duplicate", "truncated", "illegal", "cost")
    schema = f"key string, first long, edits array<struct<state:int,labels:string>>, {', '.join(f'{n} long' for n in longs)}, audit string"
    edits = pa.list_(pa.struct([("state", pa.int32()), ("labels", pa.string())]))
    fields = pa.schema([("key", pa.string()), ("first", pa.int64()), ("edits", edits), *((n, pa.int64()) for n in longs), ("audit", pa.string())])

    def done(key: str, blocks: list[tuple[int, str]], weights: Weights) -> Iterator[pa.RecordBatch]:
        cost, audit = finished(weights)
        counts = [sum(s[1::2].count(f) for _, s in blocks) for f in (BLANK, DUPLICATE, CUT)]
        edges = sum(illegal_pairs(a[-2] + b[0]) for (_, a), (_, b) in zip(blocks, blocks[1:], strict=False))
        yield _batch([(key, None, None, *counts, edges + sum(illegal_pairs(s[::2]) for _, s in blocks), cost, audit)], fields)
        state, rest = 0, audit
        for k, (first, symbols) in enumerate(blocks):
            parts, rest = by_row(rest, len(symbols) // 2)
            if k == len(blocks) - 1:  # what follows the last row goes with it
                parts[-1] += rest
            rows = []
            for labels, initial in zip(parts, symbols[::2], strict=True):
                rows.append({"state": state, "labels": labels})
                state = _moved(state, labels, initial)
            yield _batch([(key, first, rows, *[None] * 6)], fields)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, weights, blocks = None, {}, []
        for batch in batches:
            for own, first, symbols, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    if key is not None:
                        yield from done(key, blocks, weights)
                    key, weights, blocks = own, {0: (0, "")}, []
                matrix: dict[int, Weights] = {}
                for c in cells:
                    matrix.setdefault(c["start"], {})[c["stop"]] = (c["cost"], c["labels"])
                weights = times(weights, matrix)
                blocks.append((first, symbols))
        if key is not None:
            yield from done(key, blocks, weights)

    return matrices.repartition("key").sortWithinPartitions("key", "first").select("key", "first", "symbols", "cells").mapInArrow(fold, schema)


def _lines(edited: DataFrame) -> DataFrame:
    """The turns that a row's labels leave of it: key, pos, turns."""
    schema = "key string, pos long, turns array<struct<role:string,text:string>>"
    turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    fields = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("turns", turns)])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield _batch([(key, pos, [{"role": r, "text": t} for r, t in edit(state, labels, role, text)[1]]) for key, pos, role, text, state, labels in rows], fields)

    return edited.select("key", "pos", "role", "text", "state", "labels").mapInArrow(write, schema)


def _digests(lines: DataFrame) -> DataFrame:
    """The SHA-256 of each conversation's turns, streamed in order."""
    fields = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun = None, hashlib.sha256(), False
        for batch in batches:
            for own, turns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    if key is not None:
                        yield _batch([(key, state.hexdigest())], fields)
                    key, state, begun = own, hashlib.sha256(), False
                for t in turns:
                    state.update(("\n" * begun + f"{t['role']}:{t['text']}").encode())
                    begun = True
        if key is not None:
            yield _batch([(key, state.hexdigest())], fields)

    return lines.repartition("key").sortWithinPartitions("key", "pos").select("key", "turns").mapInArrow(digest, "key string, repaired_sha256 string")


def _long(rows: DataFrame, digest: bool) -> DataFrame:
    """Conversations that no task should hold: the same result by blocks of their order."""
    known = materialize(rows.groupBy("key").agg(F.first("conv_id").alias("conv_id")))
    each = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    order = ["key", F.col("turn").asc_nulls_first(), "role"]
    # The bounds of ranges are sampled by the driver, so of texts they have the beginning only.
    ranged = each.repartitionByRange(shuffle_partitions(rows.sparkSession), *order, F.left("text", F.lit(64))).sortWithinPartitions(*order, "text")
    blank, cut = _faults(F.col("text"))
    facts = {"pos": F.monotonically_increasing_id(), "initial": _initial(F.col("role")), "digest": F.sha2(F.col("text").cast("binary"), 256), "blank": blank, "cut": cut}
    placed = materialize(ranged.select("key", "turn", "role", "text").withColumns(facts))

    firsts = placed.groupBy("key", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    told = placed.select("key", "pos", "initial", "blank", "cut").join(firsts, "pos", "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("new").isNull(), DUPLICATE).when(F.col("cut"), CUT).otherwise(FINE)
    symbol = F.struct("pos", F.concat("initial", fault).alias("symbol"))
    rows_of = F.sort_array(F.collect_list(symbol))  # at most BLOCK
    blocks = told.groupBy("key", F.expr(f"pos div {BLOCK}").alias("block")).agg(rows_of.alias("r"))
    blocks = blocks.select("key", "block", F.get("r", F.lit(0)).getField("pos").alias("first"), F.array_join(F.transform("r", lambda x: x.getField("symbol")), "").alias("symbols"))
    paths = materialize(_paths(_matrices(blocks)))

    edits = paths.where("first IS NOT NULL").select("first", F.posexplode("edits").alias("i", "e"))
    edits = edits.select((F.col("first") + F.col("i")).alias("pos"), "e.state", "e.labels")
    lines = _lines(placed.join(edits, "pos"))
    if not digest:
        kept = lines.select("key", "pos", F.posexplode("turns").alias("i", "t"))
        return kept.join(known, "key").select("conv_id", (F.col("pos") * (1 << 12) + F.col("i")).alias("position"), "t.role", "t.text")
    spans = placed.groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key").agg(F.min("turn").alias("least"), F.max("turn").alias("most"), F.count("turn").alias("n"))
    wide = [F.col(c).cast("decimal(38,0)") for c in ("least", "most")]
    gaps = F.when(F.col("n") > 0, F.least(wide[1] - wide[0] + 1 - F.col("n"), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long"))
    counts = paths.where("cost IS NOT NULL").drop("first", "edits")
    found = known.join(counts, "key", "left").join(spans, "key", "left").join(_digests(lines), "key", "left")
    longs = [F.coalesce(c, F.lit(0)).alias(n) for n, c in (("gaps", gaps), *((n, F.col(n)) for n in ("blank", "duplicate", "truncated", "illegal", "cost")))]
    return found.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def _split(rows: DataFrame, digest: bool, long_rows: int, long_bytes: int) -> DataFrame:
    prepared = _prepared(rows)
    sizes = prepared.groupBy("key").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text") * F.col("copies")).alias("bytes"))
    large = materialize(sizes.where((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select("key"))
    found = large.count()
    if not found:
        return _short(prepared, digest)
    keys = F.broadcast(large) if found <= BROADCAST_KEYS else large
    return _short(prepared.join(keys, "key", "left_anti"), digest).unionByName(_long(prepared.join(keys, "key", "left_semi"), digest))


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation of rows.

    rows has conv_id, turn, role and text, and may have copies: a row counts so often, and 0 leaves of it only that there
    was such a conversation. Faults are counted before the repair, each row's first.
    """
    return _split(rows, True, long_rows, long_bytes)


def repaired_turns(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """conv_id, position, role and text of the repaired turns; positions give the order and may have gaps."""
    return _split(rows, False, long_rows, long_bytes)
