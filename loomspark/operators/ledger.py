"""The ledger: runs, calls, snapshots and facts as append-only tables, current state as views over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: What a run or a call adds up to.
PAGES, TOKENS = ("pages_ok", "pages_err"), ("prompt_tokens", "completion_tokens")


def activity(runs: DataFrame, offset_minutes: int, since: str | None = None) -> DataFrame:
    """Runs by local day, command and status. runs: ts, command, status, PAGES, TOKENS, usd. Watch checks are not runs."""
    day = F.to_date(F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(offset_minutes), F.lit(0)))
    rows = _since(runs.where("command <> 'watch'"), since).withColumn("day", day).where("day IS NOT NULL")
    sums = [F.count("*").alias("runs"), *(F.sum(c).alias(c) for c in (*PAGES, *TOKENS)), F.round(F.sum("usd"), 6).alias("usd")]
    return rows.groupBy("day", "command", "status").agg(*sums)


def spend_by(calls: DataFrame, key: str = "provider", since: str | None = None) -> DataFrame:
    """Calls, TOKENS and usd of each provider. calls: ts, the key, TOKENS, usd."""
    sums = [F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in TOKENS), F.round(F.sum("usd"), 6).alias("usd")]
    return _since(calls, since).groupBy(key).agg(*sums)


def _since(rows: DataFrame, since: str | None) -> DataFrame:
    return rows.where(F.col("ts") >= F.lit(since).cast("timestamp")) if since else rows


def status_counts(state: DataFrame, statuses: tuple[str, ...], by: str | None = None) -> DataFrame:
    """One column for each status; one row, or one for each value of `by`."""
    columns = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    return state.groupBy(by).agg(*columns) if by else state.agg(*columns)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key: an upsert log read as a table, or the last snapshot of a page."""
    struct = F.struct(*order, *(c for c in rows.columns if c not in order and c != key))
    newest = rows.groupBy(key).agg(F.max(struct).alias("r"))
    return newest.select(key, *(F.col(f"r.{c}") for c in rows.columns if c != key))


def change_flags(versions: DataFrame, key: str, order: list[str], content: str) -> DataFrame:
    """changed: whether the content differs from the version before; the first version is the baseline."""
    before = F.lag(content).over(Window.partitionBy(key).orderBy(*order))
    return versions.withColumn("changed", F.coalesce(before != F.col(content), F.lit(False)))


def newest(versions: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return versions.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def null_rates(outcomes: DataFrame, keys: list[str], order: list[str], is_null: Column, window: int = 50, threshold: float = 0.30) -> DataFrame:
    """The share of nulls among the last `window` outcomes, and whether it calls for healing (without the reset)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(window - 1), 0)
    seen, rate = F.count("*").over(w), F.avg(is_null.cast("double")).over(w)
    out = outcomes.withColumns({"seen": seen, "null_rate": rate})
    return out.withColumn("trigger", (F.col("seen") >= window // 5) & (F.col("null_rate") > threshold))


_KINDS = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}


def fold_sorted(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], begin: Callable, step: Callable, end: Callable, schema: str) -> DataFrame:
    """keys and what end(state) gives, for each key: step(state, row) over its rows in order, from begin().

    Rows are sorted by Spark, which spills, and fold as they pass, so a key of any length needs no more than its state.
    """
    at = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def made() -> pa.RecordBatch:
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(T.StructType([*known, *added]))
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
            done.clear()
            return out

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:at] != key or state is None:
                    if state is not None:
                        done.append((*key, *end(state)))
                    key, state = row[:at], begin()
                state = step(state, row[at:])
            if len(done) > 10_000:
                yield made()
        if state is not None:
            done.append((*key, *end(state)))
        if done:
            yield made()

    known = [rows.schema[k] for k in keys]
    added = [T.StructField(n, _KINDS[k]) for n, k in (part.split() for part in schema.split(", "))]
    sorted_rows = rows.select(*keys, *columns, *(F.col(o).alias(f"_o{i}") for i, o in enumerate(order))).repartition(*keys)
    sorted_rows = sorted_rows.sortWithinPartitions(*keys, *(f"_o{i}" for i in range(len(order)))).select(*keys, *columns)
    return sorted_rows.mapInArrow(fold, T.StructType([*known, *added]))


def null_rate_resets(outcomes: DataFrame, keys: list[str], order: str, is_null: str, window: int = 50, threshold: float = 0.30) -> DataFrame:
    """outcomes, triggers and in_ring of each key, with the ring cleared at each trigger: later states depend on earlier ones."""

    def step(state: tuple, row: tuple) -> tuple:
        ring, seen, fired = state
        ring = [*ring, int(bool(row[0]))][-window:]
        fire = len(ring) >= window // 5 and sum(ring) / len(ring) > threshold
        return ([] if fire else ring), seen + 1, fired + fire

    end = lambda s: (s[1], s[2], len(s[0]))
    return fold_sorted(outcomes, keys, [order], [is_null], lambda: ([], 0, 0), step, end, "outcomes int, triggers int, in_ring int")


def streaks(rows: DataFrame, keys: list[str], order: list[str], good: Column) -> DataFrame:
    """streak: how many rows in a row, up to this one, were not good."""
    w = Window.partitionBy(*keys).orderBy(*order)
    island = rows.withColumn("_good", good.cast("int")).withColumn("_island", F.sum("_good").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("streak", F.sum(1 - F.col("_good")).over(inside)).drop("_good", "_island")


def mint_ids(facts: DataFrame, run: str, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """fact_id f1, f2, .. within each run, in input order, after those that exist."""
    n = F.row_number().over(Window.partitionBy(run).orderBy(*order))
    if existing is None:
        return facts.withColumn("fact_id", F.concat(F.lit("f"), n))
    last = existing.groupBy(run).agg(F.max(F.substring("fact_id", 2, 18).cast("long")).alias("_last"))
    return facts.join(last, run, "left").withColumn("fact_id", F.concat(F.lit("f"), n + F.coalesce("_last", F.lit(0)))).drop("_last")


def forget_run(snapshots: DataFrame, links: DataFrame, facts: DataFrame, run_id) -> DataFrame:
    """The snapshots that stay when a run is forgotten: all but those only it links to, unless another run's fact cites them."""
    keys = ["url_hash", "checked_at"]
    own = links.where(F.col("run_id") == run_id).select(*keys).distinct()
    others = links.where(F.col("run_id") != run_id).select(*keys).unionByName(facts.where(F.col("run_id") != run_id).select(*keys)).distinct()
    return snapshots.join(own.join(others, keys, "left_anti"), keys, "left_anti")


def claim(state: DataFrame, n: int) -> DataFrame:
    """The next n pending rows, in flight: events to append to the state log."""
    return state.where("status = 'pending'").orderBy("discovered_at", "url_hash").limit(n).withColumn("status", F.lit("inflight"))


def within_ceiling(calls: DataFrame, by: list[str], order: list[str], usd: str, ceiling: float) -> DataFrame:
    """running: spend before a call; admitted: whether the call still fits under the ceiling."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.round(F.sum(usd).over(w), 6), F.lit(0.0))
    return calls.withColumn("running", running).withColumn("admitted", F.col("running") + F.col(usd) <= ceiling)


def throttle(reports: DataFrame, host: str, order: str, floor: float = 1.0, most: float = 60.0) -> DataFrame:
    """A host's delay after all its answers: doubled by 429 and 5xx, three quarters after 2xx, not under the floor."""

    def step(delay: float, row: tuple) -> float:
        status, asked = row
        if status is not None and (status == 429 or 500 <= status <= 599):
            return min(most, delay * 2) if asked is None else min(300.0, max(delay, float(asked)))
        return max(floor, delay * 0.75) if status is not None and 200 <= status <= 299 else delay

    return fold_sorted(reports, [host], [order], ["status", "retry_after"], lambda: floor, step, lambda d: (d,), "delay double")


#: From which states a research run may go to which (fixed values).
TRANSITIONS = {"launch": (None,), "running": ("launch", "running", "writing"), "writing": ("running",), "done": ("writing", "running"), "failed": ("launch", "running", "writing"), "stopped": ("launch", "running", "writing")}


def valid_transitions(log: DataFrame, run: str, order: list[str]) -> DataFrame:
    """valid: whether a state may follow the one before it in its run; done, failed and stopped are the end."""
    before = F.lag("status").over(Window.partitionBy(run).orderBy(*order))
    valid = F.lit(False)
    for status, sources in TRANSITIONS.items():
        ok = before.isNull() if sources == (None,) else before.isin(*sources)
        valid = valid | ((F.col("status") == status) & ok)
    return log.withColumn("valid", F.coalesce(valid, F.lit(False)))


VERDICTS = ("verified", "softened", "dropped", "contested")


def apply_verdicts(facts: DataFrame, verdicts: DataFrame, order: str) -> DataFrame:
    """facts (run_id, fact_id, status, note) under the first valid verdict of each; a softened one needs a note.

    Later verdicts on a fact and verdicts on unknown facts are ignored.
    """
    good = verdicts.where(F.col("status").isin(*VERDICTS) & ((F.col("status") != "softened") | (F.coalesce("note", F.lit("")) != "")))
    first = good.groupBy("run_id", "fact_id").agg(F.min(F.struct(order, "status", "note")).alias("v"))
    joined = facts.join(first, ["run_id", "fact_id"], "left")
    return joined.select("run_id", "fact_id", F.coalesce("v.status", "status").alias("status"), F.when(F.col("v").isNotNull(), F.col("v.note")).otherwise(F.col("note")).alias("note"))


def resume(state: DataFrame) -> DataFrame:
    """The crawl state to go on with after a break: what was in flight is pending again."""
    return state.withColumn("status", F.when(F.col("status") == "inflight", "pending").otherwise(F.col("status")))


def enqueue(queue: DataFrame, found: DataFrame, key: str = "url_hash") -> DataFrame:
    """Rows of found that the queue does not have yet, each key once: insert or ignore."""
    return found.dropDuplicates([key]).join(queue.select(key), key, "left_anti")


def schedule(fetches: DataFrame, host: str, order: list[str], rate: float = 1.0, burst: int = 3) -> DataFrame:
    """earliest: seconds after the start at which a host's token bucket admits each fetch, all asked for at once."""
    n = F.row_number().over(Window.partitionBy(host).orderBy(*order))
    return fetches.withColumn("earliest", F.greatest(F.lit(0.0), (n - burst) / F.lit(rate)))


def attach_pages(hits: DataFrame, pages: DataFrame, n: int) -> DataFrame:
    """Search hits with the pages that were read for the first n of each query, by (query, rank)."""
    return hits.join(pages.where(F.col("rank") <= n), ["query", "rank"], "left")


def evict(selectors: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The selector table without the rows that match on the keys; no keys clear it."""
    return selectors.join(gone.select(*keys).distinct(), keys, "left_anti") if keys else selectors.limit(0)
