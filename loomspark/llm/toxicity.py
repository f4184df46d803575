"""Toxicity by the nearest labelled examples, under exact TF-IDF cosine, with evidence.

The space has a dimension for every word (a run of letters, lower-cased) of the labelled examples, and for those of their
beginnings of 4, 5 and 6 letters that speak for toxicity, which stand for a stem with any ending. A feature that toxic
examples hold more often than others, by the log-likelihood ratio, weighs LIFT times its TF-IDF. Document frequencies are
counted over all documents. A word that no example has can meet none; it lengthens its text's vector like a word of one
document.

The examples are a bounded sample of labelled rows (EXAMPLES, the least hashes of doc_id), and those with the same vector
are one entry with their counts, so the index has a proven size and is broadcast. It is an inverted index whose
postings are cut into blocks of entries, with each feature's largest weight in each block. The DENSE most common features,
whose postings name most entries, are columns of a matrix instead, and are scored for many texts at once. A search adds
up the blocks' bounds for a text, the largest share of the common features and the postings' largest weights, scores the
blocks with the highest bounds, and then all blocks whose bound reaches the kth cosine found there; it returns the exact
nearest entries.

The k nearest examples vote with their cosine (one less the distance) as weight, against a vote of weight PRIOR_VOTE for
the rate among all examples, so that far neighbours say little. Votes become scores by isotonic regression on the examples'
own votes, each made without the example itself. A text without a neighbour gets the rate among such examples. Evidence is
the nearest entry's example, its cosine, and the features of the text that speak for toxicity, heaviest first.

Documents are read twice, for document frequencies and for scores; no text is shuffled.

Defined results: null and empty texts have no features; a doc_id with several labels is toxic if one of them
is, null labels count as none; a doc_id with several texts gives one example, the one with the least hash; null and
repeated doc_ids are scored row by row; of equally near entries the first in the index's order counts; without labelled
examples every score is 0. Only doc_id and text of the documents are used.
"""

from __future__ import annotations

import pickle
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_of, fold, least_hashes, materialize, sliced

EXAMPLES = 20000
#: The least log-likelihood ratio, times two, of a feature that speaks for toxicity; how much likelier it must be in toxic texts; its weight.
LEAST_G2, LEAST_LIFT, LIFT = 20.0, 4.0, 6.0
NEIGHBOURS = 15
PRIOR_VOTE = 2.0
THRESHOLD = 0.3
BLOCK = 128
#: Blocks that are scored before the kth cosine is asked for.
FIRST_BLOCKS = 8
#: Features whose weights are held as a matrix, and texts that are scored with it at once.
DENSE, TOGETHER = 512, 64
#: Bytes of the packed index in a row.
PIECE = 4 << 20
#: Entries whose postings are weighed at once.
INVERTED = 1024
FOLDS, TEST_FOLD = 4, 2
_SEED = 42
_WORDS = re.compile(r"[^\W\d_]+")


def held_out(folds: int = FOLDS, of: int = TEST_FOLD) -> Column:
    """Whether a row is kept from training, by crc32 of its doc_id as text; a null doc_id counts as empty."""
    return fold(folds) == of


def stems_of(word: str) -> list[str]:
    return [word[:n] + "*" for n in (4, 5, 6) if len(word) > n]


def words_of(text: bytes | str | None) -> Counter:
    return Counter(_WORDS.findall((text or "").lower()))


def _text_features(text: str) -> set[str]:
    return {f for w in words_of(text) for f in (w, *stems_of(w))}


def feature_counts(examples: DataFrame) -> DataFrame:
    """feature, toxic, clean: in how many examples (text, toxic) of each label a feature is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def take() -> pa.RecordBatch:
            names = list(toxic.keys() | clean.keys())
            columns = [pa.array(names, pa.string()), pa.array([toxic[f] for f in names], pa.int64()), pa.array([clean[f] for f in names], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["feature", "toxic", "clean"])

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update(_text_features(text.as_py() or ""))
            if len(toxic) + len(clean) > 1_000_000:
                yield take()
                toxic, clean = Counter(), Counter()
        yield take()

    counted = examples.select("text", "toxic").mapInArrow(count, "feature string, toxic long, clean long")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_features(counts: DataFrame, toxic: int, clean: int) -> list[str]:
    """All features that speak for toxicity, strongest first; the examples' own words bound them."""
    n = toxic + clean
    if not toxic or not clean:
        return []
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    t, c = F.col("toxic"), F.col("clean")
    rate = (t + c) / n
    g2 = 2 * (part(t, rate * toxic) + part(c, rate * clean) + part(toxic - t, (1 - rate) * toxic) + part(clean - c, (1 - rate) * clean))
    lift = (t / toxic) / ((c + 0.5) / clean)
    kept = counts.where((t > 0) & (lift >= LEAST_LIFT)).withColumn("g2", g2).where(F.col("g2") >= LEAST_G2)
    return [r.feature for r in kept.orderBy(F.desc("g2"), "feature").collect()]


class Space:
    """The dimensions: hashes of the examples' words, in order, and of the stems that speak for toxicity."""

    def __init__(self, chosen: list[str], hashes: np.ndarray):
        self.chosen = chosen
        self.terms = np.unique(np.concatenate([hashes.astype(np.uint64), np.array([self.hash(f) for f in chosen], np.uint64)]))
        self.start()

    def start(self) -> None:
        self.names = {int(np.searchsorted(self.terms, np.uint64(self.hash(f)))): f for f in self.chosen}
        self.stems = {f: n for n, f in self.names.items() if f.endswith("*")}
        self.begins = {f[:4] for f in self.stems}
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.chosen, self.terms

    def __setstate__(self, state) -> None:
        self.chosen, self.terms = state
        self.start()

    @staticmethod
    def hash(feature: str) -> int:
        from xxhash import xxh64_intdigest

        return xxh64_intdigest(feature.encode(), _SEED)

    def meet(self, words: set[str]) -> None:
        """Look words up that have not been looked up yet: -1 is for a word that no example has."""
        from xxhash import xxh64_intdigest

        if len(self.known) > 150_000:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        hashes = np.array([xxh64_intdigest(w, _SEED) for w in new], np.uint64)
        at = np.searchsorted(self.terms, hashes)
        own = np.where(np.append(self.terms, np.uint64(0))[at] == hashes, at, -1) if len(self.terms) else np.full(len(new), -1)
        for word, i, last in zip(new, own.tolist(), (at == len(self.terms)).tolist(), strict=True):
            more = [self.stems[s] for s in stems_of(word) if s in self.stems] if word[:4] in self.begins else ()
            self.known[word] = (-1 if last else i, *more)

    def vectors(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """For each text: dimensions in order and their counts, and the squared length that all other words add, before their idf."""
        counted = [words_of(t) for t in texts]
        self.meet(set().union(*counted))
        out, known = [], self.known
        for words in counted:
            seen: dict[int, int] = {}
            other: list[int] = []
            for word, times in words.items():
                for i in known[word]:
                    if i < 0:
                        other.append(times)
                    else:
                        seen[i] = seen.get(i, 0) + times
            ids = np.fromiter(seen, np.int64, len(seen))
            order = np.argsort(ids)
            rest = float(((1 + np.log(other)) ** 2).sum()) if other else 0.0
            out.append((ids[order], np.fromiter(seen.values(), np.int64, len(seen))[order], rest))
        return out


def _spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of spans one after another, and the spans' sizes."""
    sizes = end - begin
    last = np.cumsum(sizes)
    return np.repeat(begin - (last - sizes), sizes) + np.arange(last[-1] if len(last) else 0), sizes


class BlockMaxIndex:
    """Exact nearest entries by cosine. Entries have a vector, counts of toxic and clean examples, and a doc_id."""

    def __init__(self, idf: np.ndarray, other: float, block: int = BLOCK):
        """idf: the weight of each dimension. other: that of a word outside."""
        self.idf, self.other, self.block = np.asarray(idf, float), other, block
        self.made: dict[tuple[bytes, bytes], list] = {}
        self.prior = self.default = 0.0
        self.steps: tuple[list[float], list[float]] = ([0.0], [0.0])

    def weigh(self, ids: np.ndarray, counts: np.ndarray, rest: float = 0.0) -> np.ndarray:
        weights = (1 + np.log(counts)) * self.idf[ids]
        length = np.sqrt(weights @ weights + rest * self.other**2)
        return weights / length if length else weights

    def add(self, ids: np.ndarray, counts: np.ndarray, toxic: bool, doc_id) -> None:
        entry = self.made.setdefault((np.asarray(ids, np.int32).tobytes(), np.asarray(counts, np.int32).tobytes()), [0, 0, doc_id])
        entry[0 if toxic else 1] += 1

    def close(self) -> None:
        """Lay the entries out, those that share their heaviest and most common features together, which makes bounds tight."""
        entries = []
        rank = np.argsort(np.argsort(self.idf, kind="stable"), kind="stable")
        for (packed, times), (toxic, clean, doc_id) in self.made.items():
            ids, counts = np.frombuffer(packed, np.int32), np.frombuffer(times, np.int32)
            by = ids[np.argsort(rank[ids], kind="stable")]
            entries.append(((int(by[-1]) if toxic else -1, by[:3].tolist(), packed, times), ids, counts, toxic, clean, doc_id))
        entries.sort(key=lambda e: e[0])
        self.made = {}
        self.votes = np.array([e[3:5] for e in entries], float).reshape(-1, 2)
        self.examples = [e[5] for e in entries]
        self.ids = np.concatenate([np.zeros(0, np.int32), *(e[1] for e in entries)])
        self.counts = np.concatenate([np.zeros(0, np.int32), *(e[2] for e in entries)])
        self.edges = np.cumsum([0, *(len(e[1]) for e in entries)])
        self.matrix = None

    def invert(self) -> None:
        """Postings by dimension and entry, and (dimension, block) pairs with their largest weight; made where it is searched."""
        n = len(self.examples)
        common = np.argsort(-np.bincount(self.ids, minlength=len(self.idf)), kind="stable")[:DENSE]
        self.column = np.full(len(self.idf), -1)
        self.column[common] = np.arange(len(common))
        self.blocks = -(-n // self.block)
        # Rows are filled up to whole blocks.
        self.matrix = np.zeros((self.blocks * self.block, len(common)), np.float32)
        rare = self.column[self.ids] < 0
        ids, entry, weights = self.ids[rare], np.empty(int(rare.sum()), np.int32), np.empty(int(rare.sum()), np.float32)
        del rare
        done = 0
        for first in range(0, n, INVERTED):  # a stretch of entries at a time, which bounds what is held beside the result
            span = slice(self.edges[first], self.edges[min(n, first + INVERTED)])
            own = np.repeat(np.arange(first, min(n, first + INVERTED)), np.diff(self.edges[first : first + INVERTED + 1]))
            values = (1 + np.log(np.maximum(self.counts[span], 1))) * self.idf[self.ids[span]]
            values /= np.sqrt(np.bincount(own, values**2, minlength=n))[own]
            column = self.column[self.ids[span]]
            dense = column >= 0
            self.matrix[own[dense], column[dense]] = values[dense]
            more = len(own) - int(dense.sum())
            entry[done : done + more], weights[done : done + more] = own[~dense], values[~dense]
            done += more
        order = np.argsort(ids, kind="stable")
        self.entry, self.weight, ids = entry[order], weights[order], ids[order]
        del order, entry, weights
        pair = ids.astype(np.int64) * (self.blocks + 1) + self.entry // self.block
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        self.pair_edges = np.append(first, len(pair))
        self.pair_block = self.entry[first] // self.block
        self.pair_most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.term_edges = np.searchsorted(ids[first], np.arange(len(self.idf) + 1))

    def forget(self) -> None:
        """Keep what searches need only: without the entries' own vectors, and so not to be sent on."""
        if self.matrix is None:
            self.invert()
        self.ids = self.counts = None

    def __getstate__(self):
        packed = zlib.compress(self.ids.astype(np.int32).tobytes() + self.counts.astype(np.int32).tobytes(), 1)
        return self.idf, self.other, self.block, self.prior, self.default, self.steps, self.votes, self.examples, self.edges, packed

    def __setstate__(self, state) -> None:
        self.idf, self.other, self.block, self.prior, self.default, self.steps, self.votes, self.examples, self.edges, packed = state
        self.made = {}
        self.ids, self.counts = np.frombuffer(zlib.decompress(packed), np.int32).reshape(2, -1)
        self.matrix = None

    def shares(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common features add to each entry's cosine, for (dimensions, weights) of several texts."""
        if self.matrix is None:
            self.invert()
        asked = np.zeros((len(vectors), self.matrix.shape[1]), np.float32)
        for row, (ids, weights) in zip(asked, vectors, strict=True):
            at = self.column[ids]
            row[at[at >= 0]] = weights[at >= 0]
        return (asked @ self.matrix.T).astype(float)

    def search(self, ids: np.ndarray, weights: np.ndarray, k: int, share: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The k nearest entries as (cosine, entry), best first, ties to the smaller entry; only positive cosines.

        share: the text's row of shares(), if that has been made with others.
        """
        if not len(ids) or not self.examples:
            return []
        scores = self.shares([(ids, weights)])[0] if share is None else share
        pairs, sizes = _spans(self.term_edges[ids], self.term_edges[ids + 1])
        of, block = np.repeat(weights, sizes), self.pair_block[pairs]
        bound = scores.reshape(self.blocks, self.block).max(axis=1) + np.bincount(block, of * self.pair_most[pairs], minlength=self.blocks)
        n = len(self.examples)
        todo, least, done = np.argsort(-bound, kind="stable")[:FIRST_BLOCKS], 0.0, np.zeros(self.blocks, bool)
        while len(todo):
            chosen = np.zeros(self.blocks, bool)
            chosen[todo] = True
            done |= chosen
            own = pairs[chosen[block]]
            at, sizes = _spans(self.pair_edges[own], self.pair_edges[own + 1])
            entries = self.entry[at]
            scores += np.bincount(entries, np.repeat(of[chosen[block]], sizes) * self.weight[at], minlength=len(scores))
            seen = scores.reshape(self.blocks, self.block)[done].reshape(-1)
            # A block whose bound is not above the kth cosine, or is nothing, has no nearer entry.
            least = float(np.partition(seen, -k)[-k]) if len(seen) >= k else 0.0
            todo = np.flatnonzero(~done & (bound + 1e-9 >= least) & (bound > 0))
        # Entries of blocks that were not scored are below the kth cosine by their bound, so by what they have as well.
        found = np.flatnonzero((scores[:n] >= max(least, 1e-12)) & np.repeat(done, self.block)[:n])
        found = found[np.lexsort((found, -scores[found]))][:k]
        return [(float(scores[i]), int(i)) for i in found]

    def vote(self, near: list[tuple[float, int]], k: int, own: tuple[int, bool] | None = None) -> tuple[float | None, int, float]:
        """The share of toxic votes, the nearest entry and its cosine, by the nearest entries. own: leave out one example of an entry."""
        toxic, total = PRIOR_VOTE * self.prior, PRIOR_VOTE
        best, left = (-1, 0.0), float(k)
        for cosine, n in near:
            t, c = self.votes[n]
            if own and own[0] == n:
                t, c = t - own[1], c - (not own[1])
            if t + c > 0:
                if best[0] < 0:
                    best = (n, cosine)
                # The k nearest examples vote, not k entries: of the last entry only as many as are left.
                weight = min(1.0, cosine) * min(1.0, left / (t + c))
                left -= min(left, t + c)
                toxic, total = toxic + weight * t, total + weight * (t + c)
                if not left:
                    break
        return (toxic / total if best[0] >= 0 else None), *best

    def own_votes(self, entries: list[int], k: int) -> list[list[float | None]]:
        """For each entry the votes for its toxic and for its clean examples, each without one of them."""
        out = []
        for at in range(0, len(entries), TOGETHER):
            some = entries[at : at + TOGETHER]
            spans = [slice(self.edges[n], self.edges[n + 1]) for n in some]
            vectors = [(self.ids[s].astype(np.int64), self.weigh(self.ids[s], self.counts[s])) for s in spans]
            for n, vector, share in zip(some, vectors, self.shares(vectors), strict=True):
                near = self.search(*vector, k + 1, share)
                out.append([self.vote(near, k, (n, label))[0] if times else None for label, times in zip((True, False), self.votes[n], strict=True)])
        return out

    def set_prior(self, empty: tuple[int, int]) -> None:
        """empty: toxic and clean examples without features."""
        toxic, clean = self.votes[:, 0].sum() + empty[0], self.votes[:, 1].sum() + empty[1]
        self.prior = toxic / (toxic + clean) if toxic + clean else 0.0
        self.default = (empty[0] + self.prior) / (sum(empty) + 1)

    def calibrate(self, votes: dict[int, list[float | None]]) -> None:
        """Isotonic regression of the labels on the entries' own votes."""
        points = []
        for n, own in sorted(votes.items()):
            for label, share, times in zip((True, False), own, self.votes[n], strict=True):
                if times:
                    points.append((self.default if share is None else share, times * label, times))
        pools: list[list[float]] = []
        for share, ones, times in sorted(points):
            pools.append([share, ones, times])
            while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]):
                _, ones, times = pools.pop()
                pools[-1][1] += ones
                pools[-1][2] += times
        # Two examples' worth of the vote itself, so that a single odd label does not set the score of its surroundings.
        values = [(ones + 2 * share) / (times + 2) for share, ones, times in pools]
        self.steps = ([p[0] for p in pools], np.maximum.accumulate(values).tolist() if values else [])

    def calibrated(self, share: float | None) -> float:
        """The score of a share of votes."""
        starts, values = self.steps
        if share is None or not values:
            return self.default
        at = bisect_right(starts, share) - 1
        if at < 0:
            return values[0]
        if at + 1 < len(starts):  # straight lines between the pools' starts keep the order of votes
            into = (share - starts[at]) / (starts[at + 1] - starts[at])
            return values[at] + into * (values[at + 1] - values[at])
        return values[at]

    def score(self, made: list[tuple[np.ndarray, np.ndarray, float]], k: int) -> list[tuple[float, int, float, np.ndarray]]:
        """For each of Space.vectors(): the calibrated score, the nearest entry, its cosine, and the text's weights."""
        out = []
        for at in range(0, len(made), TOGETHER):
            vectors = [(ids, self.weigh(ids, counts, rest)) for ids, counts, rest in made[at : at + TOGETHER]]
            for (ids, weights), share in zip(vectors, self.shares(vectors), strict=True):
                voted, nearest, cosine = self.vote(self.search(ids, weights, k, share), k)
                out.append((self.calibrated(voted), nearest, cosine, weights))
        return out


class Sealed:
    """An index as pickled bytes in pieces, which is opened where it is searched, once in a worker."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.index = pieces, None

    def open(self) -> BlockMaxIndex:
        if self.index is None:
            self.index = pickle.loads(b"".join(self.pieces))
            self.pieces = []
        return self.index


def labelled(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, text and toxic of at most `examples` training rows, those with the least hashes; written."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    rows = rows.groupBy("doc_id").agg(F.max(F.col("toxic") > 0).alias("toxic"))
    sample = materialize(least_hashes(rows, "doc_id", examples))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return materialize(texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic")))


def learn(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS) -> tuple[Broadcast, tuple[list[float], list[float]]]:
    """The space and the index (sealed), sent to the workers once, and the steps of its calibration. What a task and the driver hold is bounded by `examples`."""
    spark = docs.sparkSession
    texts = labelled(docs, labels, examples)
    sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    chosen = choose_features(feature_counts(texts), sizes.get(True, 0), sizes.get(False, 0))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: set[int] = set()
        for batch in batches:
            own.update(Space.hash(w) for text in batch.column(0).to_pylist() for w in words_of(text))
        yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(own, np.uint64, len(own)).view(np.int64))], names=["h"])

    found = [h for (h,) in columns_of(texts.select("text").mapInArrow(hashes, "h long").distinct())]
    space = Space(chosen, np.concatenate([np.zeros(0, np.int64), *found]).view(np.uint64))
    del found
    shared = spark.sparkContext.broadcast(space)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        seen, rows = np.zeros(len(of.terms), np.int64), 0
        for batch in sliced(batches):
            rows += batch.num_rows
            for ids, *_ in of.vectors(batch.column(0).to_pylist()):
                seen[ids] += 1
        ids = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, -1)), pa.array(np.append(seen[ids], rows))], names=["id", "n"])

    counted = docs.select("text").mapInArrow(frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    frequency = np.zeros(len(space.terms) + 1)
    for ids, n in columns_of(counted):
        frequency[ids] = n
    total = frequency[-1]
    idf = np.log((1 + total) / (1 + frequency[:-1]))
    idf[list(space.names)] *= LIFT
    # No weight is quite nothing, so that texts which share only words that are everywhere have neighbours.
    weights = np.maximum(idf, 0.01), max(0.01, float(np.log((1 + total) / 2)))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = shared.value.vectors(batch.column(1).to_pylist())
            packed = [pa.array([v[i].astype(np.int32).tobytes() for v in made], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *packed], names=["doc_id", "toxic", "ids", "counts"])

    def packed(index: BlockMaxIndex, empty: list[int]) -> list[tuple[int, bytes]]:
        index.close()
        index.set_prior((empty[0], empty[1]))
        whole = pickle.dumps(index)
        return [(-1, pickle.dumps((index.votes, index.default))), *((at, whole[at : at + PIECE]) for at in range(0, len(whole), PIECE))]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, empty = BlockMaxIndex(*weights), [0, 0]
        for batch in batches:
            for doc_id, toxic, ids, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(ids):
                    index.add(np.frombuffer(ids, np.int32), np.frombuffer(counts, np.int32), toxic, doc_id)
                else:
                    empty[0 if toxic else 1] += 1
        for at, part in packed(index, empty):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([part], pa.binary())], names=["at", "part"])

    schema = T.StructType([texts.schema["doc_id"], texts.schema["toxic"], *(T.StructField(n, T.BinaryType()) for n in ("ids", "counts"))])
    made = texts.select("doc_id", "text", "toxic").mapInArrow(vectors, schema)
    # One task lays the index out, whose size `examples` bounds; the driver only passes its bytes on.
    pieces = materialize(made.repartition(1).sortWithinPartitions("doc_id").mapInArrow(build, "at long, part binary"), codec="uncompressed")
    # Without examples there is no such task.
    parts_of = [(r.at, bytes(r.part)) for r in pieces.orderBy("at").toLocalIterator()] or packed(BlockMaxIndex(*weights), [0, 0])
    votes_of, default = pickle.loads(parts_of[0][1])
    sent = spark.sparkContext.broadcast((space, Sealed([part for _, part in parts_of[1:]])))
    del parts_of
    index = BlockMaxIndex(np.zeros(0), 0.0)
    index.votes, index.default = votes_of, default

    def leave_one_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = sent.value[1].open().own_votes(batch.column(0).to_pylist(), neighbours)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([v[i] for v in votes], pa.float64()) for i in (0, 1))], names=["id", "toxic", "clean"])

    parts = spark.sparkContext.defaultParallelism * 2
    votes = spark.range(0, len(votes_of), 1, parts).mapInArrow(leave_one_out, "id long, toxic double, clean double").collect()
    index.calibrate({r.id: [r.toxic, r.clean] for r in votes})
    shared.destroy()
    return sent, index.steps


def judged(docs: DataFrame, labels: DataFrame, columns: list[str], text: str, schema: T.StructType, clean_only: bool = False, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS) -> DataFrame:
    """`columns` of docs as they are, and a score, predicted and evidence for each row, or only rows not predicted toxic.

    text: the column to score; schema: that of the result.
    """
    sent, steps = learn(docs, labels, examples, neighbours)
    # The text travels once, also where it is among the columns that stay.
    asked = columns if text in columns else [*columns, text]
    at, of = len(columns), asked.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        space, index = sent.value[0], sent.value[1].open()
        index.steps = steps
        if index.ids is not None:
            index.forget()
        for batch in sliced(batches):
            rows = []
            made = space.vectors(batch.column(of).to_pylist())
            for (ids, *_), (score, nearest, cosine, weights) in zip(made, index.score(made, neighbours), strict=True):
                telling = [i for i in range(len(ids)) if int(ids[i]) in space.names]
                words = [space.names[int(ids[i])] for i in sorted(telling, key=lambda i: -weights[i])][:5]
                score = min(1.0, max(0.0, float(score)))
                rows.append((score, int(score >= THRESHOLD), index.examples[nearest] if nearest >= 0 else None, float(cosine), words))
            kept = batch.columns[:at]
            if clean_only:
                clean = pa.array([not r[1] for r in rows], pa.bool_())
                yield pa.RecordBatch.from_arrays([c.filter(clean) for c in kept], schema=arrow)
            else:
                made = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(arrow)[at:], strict=True)] if rows else [pa.array([], f.type) for f in list(arrow)[at:]]
                yield pa.RecordBatch.from_arrays([*kept, *made], schema=arrow)

    return docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(asked))).mapInArrow(judge, schema)


def toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, held_out, score, predicted, and nearest, cosine and words as evidence."""
    doc = docs.schema["doc_id"].dataType
    names = {"doc_id": doc, "held_out": T.BooleanType(), "score": T.DoubleType(), "predicted": T.IntegerType(), "nearest": doc, "cosine": T.DoubleType(), "words": T.ArrayType(T.StringType())}
    schema = T.StructType([T.StructField(n, k) for n, k in names.items()])
    return judged(docs.select("doc_id", held_out().alias("held_out"), "text"), labels, ["doc_id", "held_out"], "text", schema, examples=examples, neighbours=neighbours)


def keep_clean(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns as they are; rows are judged where they are read."""
    return judged(docs, labels, docs.columns, "text", T.StructType(docs.schema.fields), clean_only=True, **how)
