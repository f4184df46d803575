"""Mixing sources to target weights on a time-varying curriculum.

Every source has a weight and a share of the tokens that training asks for. A source's target stops
at a multiple of its size; what is over goes to the others by weight until none is above, which is the
level L with sum(min(cap, L * weight)) = demand, found from one sort of the sources by cap / weight.

The demand for a source over training time u in [0, 1] has the weight schedule
rate(u) = target * (1 + tilt * (1 - 2u)); its integral D(u) = target * ((1 + tilt) * u - tilt * u * u)
is the cumulative demand. A source's documents lie one after another in the order of a hash. Copy c of
a document whose tokens begin at a has its middle at c * source_size + a + size / 2; it is taken if
that lies below the target, and its training position is the u at which D(u) reaches it. A source's
taken words so differ from its target by half a document at most, and passes over a source follow
each other in time. The mixed stream is range-sorted by position.

The running sums within a source are made in two steps: sums by source and hash bucket, then sums within a bucket, so
a source that holds a third of all rows is spread over as many tasks as there are buckets. Buckets and order are by a hash
of doc_id and text, so rows that share a doc_id, or have none, are spread too; rows that are alike in every column are one
group until the end. All of it is DataFrame operations over doc_ids, sizes and hashes, without texts, so lost executors
mean recomputed tasks only.

Defined results: a null or empty text has size 0 and is never taken; the null source comes last and is a source like any
other; rows with the same doc_id are documents of their own, in the order of their texts' hashes; equal rows are
interchangeable; equal positions of two sources are ordered by hash; an empty table gives no rows. Columns of the input other
than doc_id, text and source are not used, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

WEIGHTS = (3.0, 1.0, 2.0)
TILTS = (0.5, 0.0, -0.5)
SHARE = 1.5
MOST_PASSES = 2.0


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, tilts=TILTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """From (source, source_size), a row for each source: adds rank, weight, tilt and target.

    The windows run over one row for each source, not over documents.
    """
    code_points = Window.orderBy(F.col("source").asc_nulls_last())
    fixed = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(code_points) - 1)
    ranked = ranked.withColumns({"weight": fixed(weights, F.col("rank")), "tilt": fixed(tilts, F.col("rank")), "cap": F.lit(most) * F.col("source_size")})
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    demand = F.lit(share) * F.sum("source_size").over(everything)
    level = (demand - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    # The first source that its cap does not stop sets the level for it and for all behind it.
    stops = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))
    level = F.first(stops, ignorenulls=True).over(everything)
    target = F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))
    return ranked.select("source", "source_size", "rank", "weight", "tilt", target.alias("target"))


def key_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The hash that orders a source's documents."""
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit(""))))


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, key, and tie, a hash of all columns; for every row of docs, without texts."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return docs.select("doc_id", "source", size_of().alias("size"), key_of().alias("key"), F.xxhash64(*plain).alias("tie"))


def _placed(sized: DataFrame, buckets: int, **how) -> DataFrame:
    """Groups of equal rows of sized, a written table: doc_id, size, key, tie, n (rows), source_size, target, tilt and begin, the words before the group."""
    groups = sized.groupBy("doc_id", "source", "size", "key", "tie").agg(F.count("*").alias("n"))
    keyed = groups.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 4), 16, 10).cast("int") * buckets / 65536).cast("int"))
    # Keys without nulls, so that the window and the join below share one shuffle.
    keyed = keyed.withColumns({"has_source": F.col("source").isNotNull(), "source": F.coalesce("source", F.lit(""))})
    source, bucket = ["has_source", "source"], ["has_source", "source", "bucket"]
    words = F.col("size") * F.col("n")
    sums = keyed.groupBy(bucket).agg(F.sum(words).alias("bucket_size"))
    running = Window.partitionBy(source).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(sums.withColumn("bucket_begin", F.coalesce(F.sum("bucket_size").over(running), F.lit(0))))
    sizes = sums.groupBy(source).agg(F.sum("bucket_size").alias("source_size"))
    named = F.when(F.col("has_source"), F.col("source")).alias("source")
    targets = source_targets(sizes.select(named, "source_size"), **how)
    targets = targets.withColumns({"has_source": F.col("source").isNotNull(), "source": F.coalesce("source", F.lit(""))})
    # At most `buckets` rows for each source.
    sums = sums.join(targets, source).select(*bucket, "bucket_begin", "source_size", "tilt", "target")
    inside = Window.partitionBy(bucket).orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keyed.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    joined = ranked.join(sums, bucket)
    return joined.withColumn("begin", F.col("bucket_begin") + F.col("inside")).drop("inside", "bucket_begin", *bucket)


def _copies(placed: DataFrame, most: float) -> DataFrame:
    """A row for each row of the groups, with positions, an array with the training position of each copy that is taken."""
    each = placed.withColumn("one", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    each = each.withColumn("begin", F.col("begin") + F.col("one") * F.col("size"))
    middle = lambda c: c * F.col("source_size") + F.col("begin") + F.col("size") / F.lit(2.0)

    def position(c: Column) -> Column:
        share, tilt = middle(c) / F.col("target"), F.col("tilt")
        bent = ((1 + tilt) - F.sqrt((1 + tilt) * (1 + tilt) - 4 * tilt * share)) / (2 * tilt)
        return F.when(tilt == 0, share).otherwise(bent)

    numbers = F.array(*(F.lit(c) for c in range(int(most))))
    taken = F.filter(numbers, lambda c: (F.col("size") > 0) & (middle(c) < F.col("target")))
    return each.withColumn("positions", F.transform(taken, position))


def mixing_report(docs: DataFrame, buckets: int = 1024, weights=WEIGHTS, tilts=TILTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """A row for each document, in the order of training: size, its source's size and target, the words taken, and the positions of its copies.

    Documents that are not taken come last.
    """
    placed = _placed(materialize(_sized(docs)), buckets, weights=weights, tilts=tilts, share=share, most=most)
    taken = (F.col("size") * F.size("positions")).alias("taken")
    rows = _copies(placed, most).select("doc_id", "size", "source_size", "target", taken, "positions", "key")
    return rows.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "key").drop("key")


def mix(docs: DataFrame, buckets: int = 1024, weights=WEIGHTS, tilts=TILTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """The mixed stream: rows of docs, repeated as often as they are taken, sorted by training position.

    The columns of docs come out as they are. Positions are found without texts; a text moves once to its positions, by
    its row's hashes, and once more in the range sort. Of rows that are equal in every column one stands for all.
    """
    placed = materialize(_placed(materialize(_sized(docs)), buckets, weights=weights, tilts=tilts, share=share, most=most))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select(key_of().alias("key"), F.xxhash64(*plain).alias("tie"), row)
    taken = (F.col("size") > 0) & (F.col("begin") + F.col("size") / 2 < F.col("target"))
    joined = rows.join(placed.where(taken), ["key", "tie"])
    single = joined.where("n = 1")
    alike = joined.where("n > 1").groupBy("key", "tie").agg(F.any_value("row").alias("row"), *(F.any_value(c).alias(c) for c in placed.columns if c not in ("key", "tie")))
    columns = ["row", *placed.columns]
    copies = _copies(single.select(columns).unionByName(alike.select(columns)), most).select("row", F.explode("positions").alias("position"), "key")
    return copies.orderBy("position", "key").select("row.*")
