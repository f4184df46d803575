"""When a host's token bucket admits each request, with arrival times and crawl delays that come up on the way.

A host's bucket holds up to `burst` tokens and fills at `rate` a second, or at one in the largest crawl delay that has been
asked for until then, if that is slower. Every request takes a token when it arrives; one that finds too few waits for what is missing,
at the rate of that moment, and those after it find a deeper hole.

The tokens left after request i are k(i) = min(k(i-1) + fill, burst) - 1. Such steps, min(k + p, q), compose into one of the
same form, so their prefixes are a running sum (of what has been filled) and a running minimum, and both are scanned in two
steps: within blocks of the hosts' order, and over one row a block. The largest delay so far and the time since the event before are
scanned likewise. A host with most of the requests is thereby in many blocks, and no task holds all its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep

_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, 0)


def _carried(rows: DataFrame, sums: dict[str, Column], carry: dict[str, tuple[Column, object]]) -> DataFrame:
    """rows with what the blocks before theirs amount to: sums by block, then carry (a window function, its start) over a host's blocks."""
    blocks = rows.groupBy("host", "block").agg(*(c.alias(n) for n, c in sums.items()))
    w = Window.partitionBy("host").orderBy("block").rowsBetween(*_BEFORE)
    start = {n: F.coalesce(c.over(w), F.lit(s)).alias(n) for n, (c, s) in carry.items()}
    return rows.join(blocks.select("host", "block", *start.values()), ["host", "block"])


def blocks_of(rows: DataFrame, keys: list[str], order: list, parts: int | None = None) -> DataFrame:
    """rows with block: numbers that follow the order of keys and order, each of rows that lie together; written, so that they stay."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep(rows.repartitionByRange(parts, *keys, *order).withColumn("block", F.spark_partition_id()))


def admissions(requests: DataFrame, delays: DataFrame, order: str, rate: float = 1.0, burst: int = 3, parts: int | None = None) -> DataFrame:
    """host, the columns of requests, wait and starts (seconds): when each request (host, at, and order for ties) may go out.

    delays: host, at and delay of the crawl delays that come up; one counts from its time on, for requests of that time too. They
    only ever slow a host down, and one that is null or not above 0 says nothing. Requests with a null time or null host are left out,
    as is everything else that is null there.
    """
    known = [c for c in requests.columns if c not in ("host", "at", "wait", "starts")]
    asked = requests.select("host", F.col("at").cast("double").alias("at"), F.lit(1).alias("request"), F.lit(0.0).alias("delay"), F.col(order).alias("tie"), F.struct(*(F.col(f"`{c}`") for c in known)).alias("row"))
    told = delays.where("delay > 0").select("host", F.col("at").cast("double").alias("at"), F.lit(0).alias("request"), F.col("delay").cast("double").alias("delay"))
    events = asked.unionByName(told, allowMissingColumns=True).where("host IS NOT NULL AND at IS NOT NULL")
    ordered = blocks_of(events, ["host"], ["at", "request", "tie"], parts)
    w = Window.partitionBy("host", "block").orderBy("at", "request", "tie")

    # The slowest delay up to the event before, and the time since it.
    sums = {"_delay": F.max("delay"), "_at": F.max("at")}
    first = _carried(ordered, sums, {"delay_before": (F.max("_delay"), 0.0), "at_before": (F.max("_at"), None)})
    gap = lambda delay: F.greatest(F.lit(1.0 / rate), delay)
    slowest = F.greatest("delay_before", F.coalesce(F.max("delay").over(w.rowsBetween(*_BEFORE)), F.lit(0.0)))
    own = F.greatest("delay_before", F.max("delay").over(w.rowsBetween(*_SO_FAR)))
    since = F.col("at") - F.coalesce(F.lag("at").over(w), F.col("at_before"), F.col("at"))
    filled = keep(first.select("host", "block", "at", "request", "tie", "row", gap(own).alias("gap"), (since / gap(slowest)).alias("fill")))

    # Tokens after a request: the least of all that capped the bucket until then, seen from now.
    level = {"taken": F.sum("request").over(w.rowsBetween(*_SO_FAR)), "filled": F.sum("fill").over(w.rowsBetween(*_SO_FAR))}
    inside = filled.withColumns(level)
    cap = F.when(F.col("request") == 1, F.col("taken") - F.col("filled"))
    inside = inside.withColumn("least", F.min(cap).over(w.rowsBetween(*_SO_FAR))).drop("fill")
    blocks = inside.groupBy("host", "block").agg(F.max("taken").alias("taken"), F.max("filled").alias("filled"), F.min("least").alias("least"))
    before = Window.partitionBy("host").orderBy("block").rowsBetween(*_BEFORE)
    shifted = blocks.withColumns({"taken0": F.coalesce(F.sum("taken").over(before), F.lit(0)), "filled0": F.coalesce(F.sum("filled").over(before), F.lit(0.0))})
    shifted = shifted.withColumn("least0", F.min(F.col("least") + F.col("taken0") - F.col("filled0")).over(before)).select("host", "block", "taken0", "filled0", "least0")
    joined = inside.join(shifted, ["host", "block"]).where("request = 1")
    offset = F.col("taken0") - F.col("filled0")
    tokens = F.least("least0", F.col("least") + offset) + (burst - 1) - (F.col("taken") + F.col("taken0")) + F.col("filled") + F.col("filled0")
    wait = F.greatest(F.lit(0.0), -tokens) * F.col("gap")
    return joined.select("host", "at", "row.*", wait.alias("wait"), (F.col("at") + wait).alias("starts"))
