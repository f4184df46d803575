"""Near-duplicates by the Jaccard similarity of word shingles, verified exactly.

Texts are linked if their sets of shingles of WORDS words (A-Z count as a-z) have a similarity of LEAST or more;
components of links get their least doc_id. Texts with the same set are one node before anything else happens.

Each set has a SimHash fingerprint, and the generalised pigeonhole (simhash.links) finds the fingerprints that differ in RADIUS
bits at most. Pairs at a similarity of 0.8 differ in up to eleven bits, and a pigeonhole over so many would probe nearly everything,
so the pairs that are further apart in bits come by keys: candidates share one of BANDS keys, each made of ROWS minimum hashes
of the set. A pair at similarity s shares none with probability (1 - s ** ROWS) ** BANDS: 0.000015 at 0.8, less above. Only texts
of candidates, of either kind, are read again and compared, by their whole sets.

In a key of up to PAIRED different texts all pairs are candidates. The texts of larger keys (a licence or a template
that many share) meet once more by an exact prefix filter over all of them together: shingles are ordered by how many of
these texts hold them, rare ones first, and two texts of a similarity of at least 0.8 share one of the first |s| - ceil(8/9 |s|) + 1
of the shorter and the first |s| - ceil(4/5 |s|) + 1 of the longer. What all share comes last in that order, so a common
passage of up to eight ninths of a text does not bring texts together. Any order will do, so counts are kept by hash in a table
of fixed size. Where more than PAIRED texts share such a shingle they are compared with leaders first, the smallest and
others by hash, as are those of a large key with the one that shares most keys with others (the source of a group of edited
copies). What leaders leave apart is settled exactly, without all pairs (settle): lists whose texts are in one component are done;
all others meet their smallest text; then all texts outside a list's largest component are compared with all of it, by parities
first, in blocks (crossing), as long as a round has at most COMPARED such comparisons for each text;
and the rest is narrowed, by the same filter in an order of the list's own. Shingles that the whole list holds bring
nobody together there: two similar texts that share no other are both similar to the smallest text, as those shingles
are eight ninths of the shorter one. So each new list is smaller than its own, and the last pairs end the work.

A null text is an empty one; texts without words have the empty set and are linked to each other only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clean_up, columns_of, materialize, written
from .graph import components, lookup
from .simhash import RADIUS, SEED, links, of_set, pick

WORDS = 5
#: The least similarity, as a fraction of integers.
LEAST = (4, 5)
BANDS, ROWS = 28, 5
#: Keys with up to so many different texts are compared pair by pair.
PAIRED = 64
LEADERS = 8
#: Comparisons of parities that settle() may make for each text before it narrows lists, and the texts on a side of a block of them.
COMPARED, BLOCK = 1 << 16, 2048
#: The most bits of a parity; longer texts have no more, so that more of their pairs are compared by their sets.
WIDEST = 1 << 15
#: Counters of shingles, by hash, that order them.
BUCKETS = 1 << 20
_CHUNK = 4096

_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(0, 2**63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _random.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
_JOIN = _random.integers(0, 2**63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _random.integers(0, 2**64, BANDS, np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of the different shingles of UTF-8 bytes; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    return np.unique(np.fromiter((xxh64_intdigest(s, SEED) for s in parts), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys by which a set finds its candidates; an empty set has none."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        least = np.minimum(least, (hashes[at : at + _CHUNK] * _FACTORS + _ADDED).min(axis=1))
    return (least.reshape(BANDS, ROWS) * _JOIN).sum(axis=1, dtype=np.uint64) ^ _BAND


def _set_id(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(hashes.tobytes(), SEED)


def _longs(values: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)])
    flat = np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))


def _ids(values: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([_set_id(h) for h in values], np.uint64).view(np.int64))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, tie, a hash of the text, same, which names the set, fp, its fingerprint, and the band keys, of every row of docs."""
    keys = T.StructField("keys", T.ArrayType(T.LongType()))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("tie", "same", "fp")), keys])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints, found = [], [], []
            for t in batch.column(2):
                hashes = shingles(t.as_py() or b"")
                ids.append(_set_id(hashes))
                prints.append(of_set(hashes))
                found.append(band_keys(hashes))
            same, fp = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (ids, prints))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), same, fp, _longs(found)], names=schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("tie"), F.col("text").cast("binary").alias("text")).mapInArrow(take, schema)


def sets(texts: DataFrame) -> DataFrame:
    """same and the set itself, of every row of texts."""
    schema = T.StructType([T.StructField("same", T.LongType()), T.StructField("set", T.ArrayType(T.LongType()))])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py() or b"") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([_ids(found), _longs(found)], names=schema.names)

    return texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(take, schema)


def by_fingerprints(distinct: DataFrame, radius: int = RADIUS, paired: int = PAIRED) -> DataFrame:
    """Pairs (a, b) to compare of a written table of sets (same, fp): those within the radius, and all of one fingerprint with its least set."""
    firsts = materialize(distinct.groupBy("fp").agg(F.min("same").alias("first")))
    own = lookup(distinct.select("same", "fp"), firsts, "fp").select(F.col("first").alias("a"), F.col("same").alias("b")).where("a <> b")
    near = materialize(links(firsts.select("fp"), radius, paired))
    named = lookup(near, firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a")
    named = named.join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return materialize(own.unionByName(named.select(F.col("x").alias("a"), F.col("y").alias("b"))))


def in_keys(keyed: DataFrame) -> DataFrame:
    """same, key and n, the number of sets with the key, of a written table of sets (same) and keys, where n is at least 2."""
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    return materialize(lookup(keyed, sizes, "key").where("n > 1").select("same", "key", "n"))


def by_keys(shared: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Pairs (a, b) to compare: all of small keys, and of large ones each set with the leaders."""
    small = shared.where(F.col("n") <= paired).groupBy("key").agg(F.sort_array(F.collect_list("same")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: x < y), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    close = small.select(F.explode(pairs).alias("e")).select("e.a", "e.b")

    large = materialize(shared.where(F.col("n") > paired))
    popular = large.groupBy("same").agg(F.sum("n").alias("popular"))
    ranked = large.join(popular, "same")
    chosen = [F.max_by("same", F.struct("popular", "same")), *(F.min_by("same", F.xxhash64("same", F.lit(i))) for i in range(1, LEADERS))]
    leaders = materialize(ranked.groupBy("key").agg(F.array_distinct(F.array(*chosen)).alias("leaders")))
    star = lookup(large, leaders, "key").select(F.explode("leaders").alias("a"), F.col("same").alias("b")).where("a <> b")
    return close.unionByName(star)


def prefixes(known: DataFrame) -> DataFrame:
    """token, same, size, at and short, for the tokens in the longer prefix of every set of known (same, set).

    at is the token's place in the order of the set, short whether it is in the prefix that a shorter set has.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy() & (BUCKETS - 1), minlength=BUCKETS)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    for buckets, n in columns_of(known.select("set").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))):
        counts[buckets] = n
    table = known.sparkSession.sparkContext.broadcast(counts)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, tokens in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = tokens.values.to_numpy()
                size = len(tokens)
                order = np.lexsort((tokens, table.value[tokens & (BUCKETS - 1)]))[: size - -(-4 * size // 5) + 1]
                short = np.arange(len(order)) < size - -(-8 * size // 9) + 1
                full = [pa.array(np.full(len(order), x)) for x in (same, size)]
                yield pa.RecordBatch.from_arrays([pa.array(tokens[order]), *full, pa.array(np.arange(len(order))), pa.array(short)], names=["token", "same", "size", "at", "short"])

    return known.where("size(set) > 0").select("same", "set").mapInArrow(take, "token long, same long, size long, at long, short boolean")


def _may(x: Column, y: Column) -> Column:
    """Whether x, no longer than y, and y can be similar by a token that is the first they share."""
    ahead = F.least(x["size"] - x["at"], y["size"] - y["at"])
    return ((x["size"] < y["size"]) | ((x["size"] == y["size"]) & (x["same"] < y["same"]))) & x["short"] & (5 * x["size"] >= 4 * y["size"]) & (9 * ahead >= 4 * (x["size"] + y["size"]))


def by_prefixes(known: DataFrame, paired: int = PAIRED) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to compare of sets (same, set): all that the prefix filter leaves in lists of up to `paired`, else with leaders.

    Also the larger lists (g, same) themselves, which settle() takes.
    """
    lists = materialize(prefixes(known))
    sizes = materialize(lists.groupBy("token").agg(F.count("*").alias("n"), F.max("short").alias("any_short")).where("n > 1 AND any_short").select("token", "n"))
    met = materialize(lookup(lists, sizes, "token").where("n > 1").select("token", "n", F.struct("same", "size", "at", "short").alias("e")))
    edge = lambda x, y: F.struct(x["same"].alias("a"), y["same"].alias("b"))
    small = met.where(F.col("n") <= paired).groupBy("token").agg(F.collect_list("e").alias("m"))
    pairs = F.flatten(F.transform(F.filter("m", lambda x: x["short"]), lambda x: F.transform(F.filter("m", lambda y: _may(x, y)), lambda y: edge(x, y))))
    close = small.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()

    large = materialize(met.where(F.col("n") > paired))
    chosen = [F.min_by("e", F.struct("e.size", "e.same")), *(F.min_by("e", F.xxhash64("e.same", F.lit(i))) for i in range(2))]
    leaders = materialize(large.groupBy("token").agg(F.array_distinct(F.array(*chosen)).alias("leaders")))
    star = lookup(large, leaders, "token").select("e", F.explode("leaders").alias("l"))
    star = star.where(_may(F.col("l"), F.col("e")) | _may(F.col("e"), F.col("l")))
    pairs = close.unionByName(star.select(F.col("l.same").alias("a"), F.col("e.same").alias("b")).distinct())
    return pairs, large.select(F.col("token").alias("g"), "e.same")


def similar(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of LEAST or more."""
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    left = lookup(pairs, known.select(F.col("same").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(known.select(F.col("same").alias("b"), F.col("set").alias("y")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("n"))
    return materialize(both.where(F.col("i") * LEAST[1] >= (F.col("n") - F.col("i")) * LEAST[0]).select("a", "b"))


def _apart(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """lists (g, same) with each text's label, of those lists only that hold more than one label; of equal lists one stays."""
    named = materialize(lookup(lists, nodes, "same").select("g", "same", F.coalesce("label", "same").alias("label")))
    alike = [F.bit_xor(F.xxhash64("same", F.lit(i))).alias(f"x{i}") for i in range(2)]
    open_ = named.groupBy("g").agg((F.min("label") < F.max("label")).alias("several"), F.count("*").alias("n"), *alike).where("several")
    kept = materialize(open_.groupBy("n", "x0", "x1").agg(F.min("g").alias("g")).select("g", "n"))
    return materialize(lookup(named, kept, "g").where("n IS NOT NULL"))


def narrowed(lists: DataFrame, known: DataFrame) -> DataFrame:
    """Smaller lists (g, same) that bring together each two similar texts of a list (g, same, n) that share more than all of it share.

    Each text's shingles are ordered by how many texts of the list hold them, and the prefix filter applies again.
    """
    sized = known.select("same", F.size("set").alias("size"), F.explode("set").alias("token"))
    held = materialize(lists.select("g", "same", "n").join(sized, "same").select("g", "same", "n", "size", F.xxhash64("g", "token").alias("h")))
    counted = lookup(held, materialize(held.groupBy("h").agg(F.count("*").alias("c"))), "h").where("c < n")
    ordered = counted.groupBy("g", "same").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("c", "h"))).alias("m"))
    reach = F.expr("slice(m, 1, size - (4 * size + 4) div 5 + 1)")
    first = materialize(ordered.select("same", "size", F.posexplode(reach).alias("at", "e")).where("e.c > 1").select(F.col("e.h").alias("g"), "same", F.expr("at < size - (8 * size + 8) div 9 + 1").alias("short")))
    sizes = materialize(first.groupBy("g").agg(F.count("*").alias("n"), F.max("short").alias("any_short")).where("n > 1 AND any_short").select("g", "n"))
    return materialize(lookup(first, sizes, "g").where("n IS NOT NULL").select("g", "same"))


def parities(known: DataFrame) -> DataFrame:
    """same, size and bits, of every row of known (same, set): the parity of the number of shingles at each bit, by hash.

    A shingle that only one of two sets has turns one bit, so as many differ as bits do at least. Twice as many bits as shingles tell sets
    at 0.78 from sets at 0.8; wider parities fold to narrower ones.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bits = [], []
            for held in batch.column(1):
                tokens = held.values.to_numpy()
                width = min(WIDEST, max(512, 1 << (2 * len(tokens) - 1).bit_length())) if len(tokens) else 512
                sizes.append(len(tokens))
                bits.append(np.packbits(np.bincount(tokens & (width - 1), minlength=width) & 1 > 0, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], names=["same", "size", "bits"])

    return known.select("same", "set").mapInArrow(take, "same long, size long, bits binary")


def _matrices(same: np.ndarray, label: np.ndarray, size: np.ndarray, bits: list[bytes]) -> dict[int, tuple]:
    """The rows by the width of their parities in bytes, ascending by size."""
    widths, out = np.array(list(map(len, bits))), {}
    for w in np.unique(widths).tolist():
        here = np.flatnonzero(widths == w)
        here = here[np.argsort(size[here], kind="stable")]
        out[w] = same[here], label[here], size[here], np.frombuffer(b"".join(bits[i] for i in here), np.uint64).reshape(len(here), -1)
    return out


def _folded(rows: np.ndarray) -> np.ndarray:
    half = rows.shape[-1] // 2
    return rows[..., :half] ^ rows[..., half:]


def _close(outside: dict[int, tuple], every: dict[int, tuple], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """a, b, their labels and the differing bits of the pairs of an outside text and any that have two labels and can be similar; each once."""
    for w, (same, label, size, rows) in outside.items():
        for v in (w // 2, w, 2 * w):
            if v not in every:
                continue
            others, labels, sizes, against = every[v]
            mine, against = _folded(rows) if v < w else rows, _folded(against) if v > w else against
            starts, ends = np.searchsorted(sizes, -(-4 * size // 5)), np.searchsorted(sizes, 5 * size // 4, "right")
            for i in np.flatnonzero(starts < ends).tolist():
                at = slice(starts[i], ends[i])
                bits = np.bitwise_count(against[at] ^ mine[i]).sum(axis=1, dtype=np.int64)
                good = (9 * bits <= size[i] + sizes[at]) & (labels[at] != label[i]) & ((labels[at] == most) | (others[at] > same[i]))
                if good.any():
                    n = int(good.sum())
                    yield np.full(n, same[i]), others[at][good], np.full(n, label[i]), labels[at][good], bits[good]


def crossing(lists: DataFrame, known: DataFrame, block: int = BLOCK) -> DataFrame:
    """The pairs (a, b) with their labels (x, y) and differing bits of all texts outside the largest component of each of lists
    (g, same, label, n, most, others) and all of its texts, that have two labels and can be similar by their parities. No pair of similar sets is left out.

    A list is compared in blocks of about `block` texts on a side, each in a task; a text goes to a block for each `block` texts of the other side.
    """
    wanted = materialize(lists.select("same").distinct())
    bits = materialize(parities(known.join(wanted, "same", "left_semi")))
    rows = lookup(lists, bits, "same").withColumn("outer", F.ceil(F.col("others") / block)).withColumn("inner", F.ceil(F.col("n") / block))
    place = F.xxhash64("same", "g")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ("g", "i", "j", "same", "label", "most", "size", "bits", "out")
    outside = rows.where("label <> most").withColumn("i", F.pmod(place, "outer")).withColumn("j", every("inner")).withColumn("out", F.lit(True)).select(*columns)
    inside = rows.withColumn("j", F.pmod(place, "inner")).withColumn("i", every("outer")).withColumn("out", F.lit(False)).select(*columns)
    names = ["a", "b", "x", "y", "bits"]

    def compare(table: pa.Table) -> pa.Table:
        out = table.column("out").to_numpy()
        numbers = [table.column(c).to_numpy() for c in ("same", "label", "size")]
        held = table.column("bits").to_pylist()
        sides = [_matrices(*(c[side] for c in numbers), [held[i] for i in np.flatnonzero(side)]) for side in (out, ~out)]
        found = list(_close(*sides, table.column("most")[0].as_py()))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * len(names)
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    met = outside.unionByName(inside).groupBy("g", "i", "j").applyInArrow(compare, ", ".join(f"{n} long" for n in names))
    return materialize(met)


def _joined(met: DataFrame, known: DataFrame, linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """linked with all links among the pairs met (a, b, x, y, bits) that components need, and the components (node, label).

    Of the pairs between two components the closest is compared first; the others are only if it leaves these apart.
    """
    first = met.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min_by(F.struct("a", "b"), F.struct("bits", "a", "b")).alias("p"))
    linked = linked.unionByName(similar(first.select("p.a", "p.b"), known))
    nodes = components(linked)
    left = lookup(met.select("a", "b"), nodes.select(F.col("node").alias("a"), F.col("label").alias("x")), "a")
    left = materialize(left.join(nodes.select(F.col("node").alias("b"), F.col("label").alias("y")), "b", "left").where("coalesce(x, a) <> coalesce(y, b)").select("a", "b"))
    more = similar(left, known)
    if more.isEmpty():
        return linked, nodes
    linked = linked.unionByName(more)
    return linked, components(linked)


def _comparable(tops: DataFrame, paired: int, budget: int) -> int:
    """How many texts may be outside a list's largest component for these to be compared with all of the list.

    paired, or the largest power of two up to which all comparisons beyond those are no more than budget together.
    """
    power = F.greatest(F.ceil(F.log2(F.greatest("others", F.lit(1)))), F.lit(0)).cast("int")
    pairs, most = 0, paired
    for p, n in tops.where(F.col("others") > paired).groupBy(power.alias("p")).agg(F.sum(F.col("others") * F.col("all"))).orderBy("p").collect():  # 64 rows at most
        pairs += n
        if pairs > budget:
            break
        most = max(most, 1 << p)
    return most


def settle(lists: DataFrame, known: DataFrame, linked: DataFrame, paired: int = PAIRED) -> DataFrame:
    """The components (node, label) of linked (a, b) and of all links between texts that share a list of lists (g, same)."""
    nodes = materialize(components(linked))
    sizes = materialize(known.select("same", F.size("set").alias("size")))
    texts = sizes.count()
    lists = _apart(lists, nodes.withColumnRenamed("node", "same"))
    while not lists.isEmpty():
        smallest = lists.join(sizes, "same").groupBy("g").agg(F.min_by("same", F.struct("size", "same")).alias("a"))
        star = lookup(lists.select("g", F.col("same").alias("b")), materialize(smallest), "g").select("a", "b")
        linked = linked.unionByName(similar(star, known))
        nodes = components(linked)
        lists = _apart(lists.select("g", "same"), nodes.withColumnRenamed("node", "same"))
        shares = lists.groupBy("g", "label").agg(F.count("*").alias("c")).groupBy("g").agg(F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("top"))
        tops = materialize(shares.select("g", F.col("top.label").alias("most"), "all", (F.col("all") - F.col("top.c")).alias("others")))
        most = _comparable(tops, paired, COMPARED * texts)
        ranked = materialize(lookup(lists, tops.drop("all"), "g"))
        linked, nodes = _joined(crossing(ranked.where(F.col("others") <= most), known), known, linked)
        rest = materialize(ranked.where(F.col("others") > most).select("g", "same", "n"))
        if rest.isEmpty():
            break
        lists = _apart(narrowed(rest, known), nodes.withColumnRenamed("node", "same"))
    return nodes


def near_duplicates(docs: DataFrame, paired: int = PAIRED) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, tie, same, and label, the component's least set.

    Written; the tables on the way to it go.
    """
    before = written()
    made = materialize(sketches(docs))
    prints = made.select("doc_id", "tie", "same")
    distinct = materialize(made.groupBy("same").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    first = written()
    near = by_fingerprints(distinct, paired=paired)
    clean_up(docs.sparkSession, first, -1)
    first = written()
    shared = in_keys(materialize(distinct.select("same", F.explode("keys").alias("key"))))
    clean_up(docs.sparkSession, first, -1)
    ends = near.select(F.explode(F.array("a", "b")).alias("same"), F.lit(2).cast("long").alias("n"))
    suspects = materialize(shared.select("same", "n").unionByName(ends).groupBy("same").agg(F.max("n").alias("n")).withColumn("label", F.col("same")))
    texts = pick(docs.select("doc_id", "text"), lookup(prints, suspects, "same").where("label IS NOT NULL"))
    known = materialize(sets(texts))
    pairs = by_keys(shared, paired).unionByName(near)
    if suspects.where(F.col("n") > paired).isEmpty():
        nodes = materialize(components(similar(pairs, known)))
    else:
        crowded = known.join(suspects.where(F.col("n") > paired).select("same"), "same", "left_semi")
        more, lists = by_prefixes(materialize(crowded), paired)
        nodes = settle(lists, known, similar(pairs.unionByName(more), known), paired)
    labelled = materialize(lookup(prints, nodes.withColumnRenamed("node", "same"), "same").withColumn("label", F.coalesce("label", "same")))
    clean_up(docs.sparkSession, before, -1)
    return labelled


def keep_one(docs: DataFrame, paired: int = PAIRED) -> DataFrame:
    """The rows of docs, one for each component, as simhash.keep_one chooses it."""
    return pick(docs, near_duplicates(docs, paired))
