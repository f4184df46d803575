"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has a bit for each bit of XXH64 over its word shingles, set if it is set in more
than half of them. Texts are linked if their fingerprints differ in few bits, and components of links
get their least doc_id.

Only different fingerprints are compared. Their 64 bits are grouped so that correlated bits share a
partition; the partitions get thresholds that may differ and may be -1 (not probed), with sum
radius - partitions + 1, for then two fingerprints within the radius are within the threshold of some
partition. A dynamic program chooses the thresholds, for each number of partitions, by estimated cost:
probes, and candidates from the distances within a sample of fingerprints. The sample (PLAN_SAMPLE at most)
only sets the plan; every plan finds every link.

A fingerprint is indexed by its bits in each partition and probes all values within the threshold. A
bucket of few probes is verified pair by pair. The fingerprints of larger buckets, which would make
pairs by the square, are linked another way, as exact: each goes to itself and its 64 one-bit neighbours
as meeting points. Two fingerprints share a meeting point if and only if they differ in at most two
bits; for a larger radius that many more flips are made. A meeting point never has more members than
flips, so no group is unbounded, whatever the number of copies.

Defined results: a null text is an empty one; texts without words have fingerprint zero and are linked
like any other; repeated rows are documents of their own; a component whose doc_ids are all null has a null
component_id. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import least_hashes, materialize
from .graph import components, lookup

WORDS, RADIUS, SEED = 3, 2, 42
PLAN_SAMPLE = 2000
#: Buckets with up to so many probes are verified pair by pair.
PAIRED = 64
_CHUNK = 1 << 16


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of UTF-8 bytes; A-Z count as a-z. bytes.split() splits at space and U+0009 to U+000D."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = found[at : at + _CHUNK + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
        hashes = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > n))


def of_set(hashes: np.ndarray) -> int:
    """The fingerprint of a set of shingle hashes, each of which counts once; zero for the empty set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[at : at + _CHUNK].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(hashes)))


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, tie, a hash of the text, and fp, the fingerprint as a signed long, of every row of docs."""
    numbers = [T.StructField(c, T.LongType()) for c in ("tie", "fp")]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *numbers])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py() or b"", words, seed) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], names=schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("tie"), F.col("text").cast("binary").alias("text")).mapInArrow(take, schema)


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of near-equal size, correlated bits together: a greedy chain, cut evenly."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).astype(float)
    bits -= bits.mean(axis=0) if len(bits) else 0
    scale = np.sqrt((bits**2).sum(axis=0)) + 1e-9
    related = np.abs(bits.T @ bits) / np.outer(scale, scale)
    np.fill_diagonal(related, -1)
    chain = [int(np.argmax(related.max(axis=1)))]
    while len(chain) < 64:
        near = related[chain[-1]].copy()
        near[chain] = -2
        chain.append(int(np.argmax(near)))
    cuts = [round(64 * i / parts) for i in range(parts + 1)]
    return [sorted(chain[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """The cheapest thresholds (from -1 up, one for each partition) with this sum, by dynamic programming.

    costs[i][t + 1] is the cost of threshold t in partition i; costs[i][0] belongs to -1.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for so_far, (cost, chosen) in best.items():
            for t, more in enumerate(own, -1):
                key = so_far + t
                if key not in step or cost + more < step[key][0]:
                    step[key] = (cost + more, [*chosen, t])
        best = step
    return best[total]


def plan(sample: list[int], count: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Partitions (bits, threshold) that are probed, for `count` fingerprints of which sample is a part."""
    values = np.array([v & (2**64 - 1) for v in sample], np.uint64)
    n = len(values)
    best: tuple[float, list] = (float("inf"), [])
    for parts in range(1, radius + 2):
        groups = group_bits(values, parts)
        costs = []
        for bits in groups:
            own = values & np.uint64(mask_of(bits))
            near = np.zeros(radius + 1)
            for i in range(n):
                apart = np.bitwise_count(own[i + 1 :] ^ own[i])
                near += np.bincount(apart[apart <= radius], minlength=radius + 1)
            share = np.cumsum(near + 0.5 ** len(bits)) / max(1, n * (n - 1) / 2)
            probes = np.cumsum([comb(len(bits), t) for t in range(radius + 1)])
            costs.append([0.0, *(count * probes + share * count * (count - 1) / 2)])
        cost, thresholds = allocate(costs, radius - parts + 1)
        if cost < best[0]:
            best = (cost, [(b, t) for b, t in zip(groups, thresholds, strict=True) if t >= 0])
    return best[1]


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def _flips(bits: list[int], most: int) -> list[int]:
    return [_signed(mask_of(list(c))) for t in range(most + 1) for c in combinations(bits, t)]


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def _probes(number: int, bits: list[int], threshold: int) -> Column:
    """The values that a fingerprint probes in a partition; own marks its own value."""
    own = F.col("fp").bitwiseAND(_signed(mask_of(bits)))
    values = F.transform(_longs(_flips(bits, threshold)), lambda flip: own.bitwiseXOR(flip))
    return F.transform(values, lambda key: F.struct(F.lit(number).alias("part"), key.alias("key"), (key == own).alias("own")))


def links(distinct: DataFrame, radius: int = RADIUS, paired: int = PAIRED, partitions: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """Edges (a, b) that connect all fingerprints fp of `distinct` within the radius, and no others.

    Every edge is a verified link; links between members of one meeting point may be left to others that
    join the same fingerprints.
    """
    if partitions is None:
        sample = [r.fp for r in least_hashes(distinct.select("fp"), "fp", PLAN_SAMPLE).collect()]
        partitions = plan(sample, distinct.count(), radius)
    probes = [_probes(number, bits, threshold) for number, (bits, threshold) in enumerate(partitions)]
    probed = distinct.select("fp", F.explode(F.concat(*probes)).alias("p")).select("fp", "p.part", "p.key", "p.own")
    probed = probed.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(16)).cast("int"))
    sizes = probed.groupBy("part", "key").agg(F.count("*").alias("n"), F.count_if("own").alias("indexed")).where("n > 1 AND indexed > 0")
    sizes = materialize(sizes)
    salted = sizes.select("part", "key", "n", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    # The hint: salted has no size bound, and its estimate, from the written table, leaves out the sixteenfold copy.
    shared = materialize(probed.join(salted.hint("merge"), ["part", "key", "salt"]).select("part", "key", "own", "fp", "n"))

    members = F.collect_list(F.struct("own", "fp"))
    small = shared.where(F.col("n") <= paired).groupBy("part", "key").agg(members.alias("m"))
    pairs = F.transform(F.filter("m", lambda x: x["own"]), lambda x: F.transform("m", lambda y: F.struct(F.least(x["fp"], y["fp"]).alias("a"), F.greatest(x["fp"], y["fp"]).alias("b"))))
    close = F.filter(F.flatten(pairs), lambda e: (e["a"] < e["b"]) & (F.bit_count(e["a"].bitwiseXOR(e["b"])) <= radius))
    verified = small.select(F.explode(F.array_distinct(close)).alias("e")).select("e.a", "e.b")

    large = shared.where(F.col("n") > paired).select("fp").distinct()
    return verified.unionByName(_meet(large, radius)).distinct()


def _meet(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges from the least member of each meeting point to its other members, verified.

    Members are within half the radius (rounded up) of the point. For an odd radius that can be one bit
    too far from each other, so there all pairs of a point are verified instead of its star; they are
    bounded by the flips.
    """
    flips = _flips(list(range(64)), (radius + 1) // 2)
    points = distinct.select("fp", F.explode(F.transform(_longs(flips), lambda f: F.col("fp").bitwiseXOR(f))).alias("point"))
    met = points.groupBy("point").agg(F.sort_array(F.collect_list("fp")).alias("m")).where("size(m) > 1")
    edge = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    if radius % 2 == 0:
        edges = F.transform(F.slice("m", 2, F.size("m") - 1), lambda y: edge(F.get("m", F.lit(0)), y))
    else:
        pairs = F.flatten(F.transform("m", lambda x: F.transform("m", lambda y: edge(x, y))))
        edges = F.filter(pairs, lambda e: (e["a"] < e["b"]) & (F.bit_count(e["a"].bitwiseXOR(e["b"])) <= radius))
    return met.select(F.explode(edges).alias("e")).select("e.a", "e.b")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, paired: int = PAIRED) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, tie, fp, label and component_id.

    tie is a hash of the text, label the component's least fingerprint.
    """
    prints = materialize(fingerprints(docs, words))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = components(links(distinct, radius, paired))
    joined = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left")
    joined = materialize(joined.withColumn("label", F.coalesce("label", "fp")))
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    component = materialize(lookup(joined, least, "label").select("fp", "label", "component_id"))
    return lookup(prints, component, "fp")


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, paired: int = PAIRED) -> DataFrame:
    """The rows of docs, one for each component: one with the least doc_id, or with none if all are null.

    Of several rows with that doc_id the one whose text has the least hash stays, once. The columns come out
    as they are; texts are shuffled once.
    """
    return pick(docs, near_duplicates(docs, words, radius, paired))


def pick(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The row of docs that stays, for each label of found (doc_id, tie and label of rows of docs).

    Of rows with one doc_id and text that differ elsewhere, the one with the least hash of all columns stays.
    """
    leader = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "tie"))
    leaders = found.groupBy("label").agg(leader.alias("l")).select("l.doc_id", "l.tie")
    key = {"_none": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))}
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select("doc_id", F.xxhash64("text").alias("_tie"), row).withColumns(key).drop("doc_id")
    chosen = leaders.withColumns(key).select("_none", "_id", F.col("tie").alias("_tie"))
    kept = rows.join(chosen, ["_none", "_id", "_tie"], "left_semi")
    plain = [F.col("row").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return kept.groupBy("_none", "_id", "_tie").agg(F.min_by("row", F.xxhash64(*plain)).alias("row")).select("row.*")
