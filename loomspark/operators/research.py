"""Research runs: options, plans, the operator's control, the budget, and the order of searches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from .rank import pick

#: Angles, tool calls and replans by effort (fixed values).
EFFORTS = {"quick": (2, 15, 0), "standard": (4, 40, 1), "deep": (8, 120, 2)}
#: The share of the money that is kept for writing.
RESERVE = 0.15
READS_A_SEARCH = 3


class OptionError(ValueError):
    """Names the option and the value that cannot be."""

    def __init__(self, option: str, value, want: str):
        super().__init__(f"{option}: {value!r}, want {want}")
        self.option = option


@dataclass(frozen=True)
class Options:
    """What a research run may do. normalized() is the one check, before anything is read."""

    max_cost_usd: float
    provider: str = ""
    effort: str = "standard"
    max_tool_calls: int = 0
    judge_provider: str = ""
    judge_model: str = ""
    allow: tuple[str, ...] = field(default=())
    deny: tuple[str, ...] = field(default=())
    prefer: tuple[str, ...] = field(default=())
    published_from: str | None = None
    published_to: str | None = None

    def normalized(self, providers: Iterable[str]) -> Options:
        """A copy with defaults filled in and domains in canonical form, sorted, once each; OptionError else."""
        known = sorted(providers)
        if self.provider not in known:
            raise OptionError("provider", self.provider, " or ".join(known))
        if self.judge_provider and (self.judge_provider not in known or not self.judge_model):
            raise OptionError("judge_provider", self.judge_provider, "a known provider with a judge_model")
        if self.effort not in EFFORTS:
            raise OptionError("effort", self.effort, " or ".join(EFFORTS))
        if not (math.isfinite(self.max_cost_usd) and self.max_cost_usd > 0):
            raise OptionError("max_cost_usd", self.max_cost_usd, "a finite amount above 0")
        if self.max_tool_calls < 0:
            raise OptionError("max_tool_calls", self.max_tool_calls, "0 or more")
        if self.published_from and self.published_to and self.published_from > self.published_to:
            raise OptionError("published_from", self.published_from, f"a day up to {self.published_to}")
        domains = {}
        for name in ("allow", "deny", "prefer"):
            try:
                domains[name] = tuple(sorted({urls.normalize_domain(d) for d in getattr(self, name)}))
            except ValueError as e:
                raise OptionError(name, getattr(self, name), "domains") from e
        return replace(self, max_tool_calls=self.max_tool_calls or EFFORTS[self.effort][1], **domains)


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def tidy_plan(angles: DataFrame, n: int) -> DataFrame:
    """The first n angles (run_id, position, question, queries) with a question; one without queries asks its question.

    Questions and queries are put on one line; blank ones go.
    """
    question = _one_line(F.col("question"))
    asked = F.filter(F.transform(F.coalesce("queries", F.array().cast("array<string>")), _one_line), lambda q: q != "")
    rows = angles.select("run_id", "position", question.alias("question"), asked.alias("queries")).where("question <> ''")
    rows = rows.withColumn("queries", F.when(F.size("queries") == 0, F.array("question")).otherwise(F.col("queries")))
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("position", "question"))
    return rows.withColumn("position", nth).where(F.col("position") <= n)


def control(messages: DataFrame, run: str, order: list[str]) -> DataFrame:
    """messages (steer, write_now) with what is in force after each: the latest steer that is not blank; write-now stays."""
    so_far = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    steer = F.last(F.when(F.trim("steer") != "", F.trim("steer")), ignorenulls=True).over(so_far)
    return messages.withColumns({"steer": F.coalesce(steer, F.lit("")), "write_now": F.coalesce(F.bool_or("write_now").over(so_far), F.lit(False))})


class Governor:
    """Check and reserve: what has been spent, what is in flight, and what a call may cost stay under the run's share."""

    def __init__(self, most: float, reserve: float = RESERVE, tools: int | None = None):
        self.most, self.research = most, most * (1 - reserve)
        self.spent, self.flying, self.tools_left, self.write_now = 0.0, {}, tools, False

    def ask(self, call: str, kind: str, projected: float, flat: bool = False) -> bool:
        """kind: research, finish (of a page that is read already) or write; a flat-rate call costs nothing."""
        if kind == "research" and self.write_now:
            return False
        if not flat:
            cap = self.most if kind == "write" else self.research
            if self.spent + sum(self.flying.values()) + projected > cap:
                return False
            self.flying[call] = projected
        return True

    def logged(self, call: str, usd: float) -> None:
        """A call's true cost; what was reserved for it is free again, once."""
        self.flying.pop(call, None)
        self.spent += usd

    def tool(self) -> bool:
        """One search or read; refused after write-now and when they are spent."""
        if self.write_now or self.tools_left == 0:
            return False
        if self.tools_left is not None:
            self.tools_left -= 1
        return True

    def boundary(self) -> bool:
        """Whether research goes on past a stage."""
        return not self.write_now and self.tools_left != 0 and self.spent < self.research


EVENTS = "run_id, seq, event (ask, logged, tool or write_now), call, kind, usd, flat"


def govern(events: DataFrame, most: float, reserve: float = RESERVE, tools: int | None = None) -> DataFrame:
    """run_id, seq, event, admitted and spent after each of EVENTS, in the order of seq within a run.

    Rows are sorted by Spark and fold as they pass, over all of the session's shuffle partitions, however few their bytes are.
    """
    kinds = [events.schema["run_id"], events.schema["seq"], T.StructField("event", T.StringType()), T.StructField("admitted", T.BooleanType()), T.StructField("spent", T.DoubleType())]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, budget = None, None
        for batch in batches:
            admitted, spent = [], []
            for own, event, call, kind, usd, flat in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)), strict=True):
                if budget is None or own != run:
                    run, budget = own, Governor(most, reserve, tools)
                usd, good = float("nan") if usd is None else usd, True
                if event == "ask":
                    good = budget.ask(call, kind, usd, bool(flat))
                elif event == "logged":
                    budget.logged(call, usd)
                elif event == "tool":
                    good = budget.tool()
                else:
                    budget.write_now = True
                admitted.append(good)
                spent.append(None if budget.spent != budget.spent else round(budget.spent, 9))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(admitted, pa.bool_()), pa.array(spent, pa.float64())], names=[k.name for k in kinds])

    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select("run_id", "seq", "event", "call", "kind", F.col("usd").cast("double"), "flat").repartition(tasks, "run_id")
    return rows.sortWithinPartitions("run_id", F.asc_nulls_last("seq"), F.asc_nulls_last("event")).mapInArrow(fold, T.StructType(kinds))


def search_queue(searches: DataFrame, done: DataFrame, most: int) -> DataFrame:
    """The next `most` searches of each angle (run_id, angle, query, kind, asked): gaps and counter-queries before planned ones.

    A query that the run has done, or that another angle asks too, is not asked again.
    """
    kind = F.when(F.col("kind").isin("gap", "counter"), 0).otherwise(1)
    once = Window.partitionBy("run_id", F.lower(F.trim("query"))).orderBy("_kind", "asked", "angle")
    fresh = searches.withColumn("_kind", kind).withColumn("_first", F.row_number().over(once)).where("_first = 1")
    fresh = fresh.join(done.select("run_id", "query").distinct(), ["run_id", "query"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("run_id", "angle").orderBy("_kind", "asked", "query"))
    return fresh.withColumn("nth", nth).where(F.col("nth") <= most).drop("_kind", "_first")


def research(plan: DataFrame, search: Callable[[DataFrame], DataFrame], read: Callable[[DataFrame], DataFrame], replan: Callable[[DataFrame], DataFrame], options: Options, allowed: Callable[[], bool], rounds: int = 8) -> DataFrame:
    """The facts (run_id, angle, url, quote) of a run, by rounds of searches and reads.

    plan: tidy_plan(). search gives hits (run_id, angle, url, rank) of queries, read the facts of hits, replan new searches
    (run_id, angle, query, kind, asked) from the facts, as often as the effort has replans. Of each search the first READS_A_SEARCH hits
    that were not visited are read. It ends when nothing is left to search, when a round finds nothing new, or when
    allowed() says so, which is asked at every stage.
    """
    from ..session import shared_dir

    def kept(df: DataFrame) -> DataFrame:
        shared_dir(df.sparkSession)
        return df.checkpoint()

    angle = F.col("position").alias("angle")
    waiting = kept(plan.select("run_id", angle, F.posexplode("queries").alias("asked", "query")).withColumn("kind", F.lit("plan")))
    done, visited, facts, left = waiting.limit(0), None, None, EFFORTS[options.effort][2]
    for _ in range(rounds):
        now = kept(search_queue(waiting, done, 1))
        if not allowed() or now.isEmpty():
            break
        done = kept(done.unionByName(now.select(done.columns)))
        hits = kept(search(now))
        seen = visited if visited is not None else hits.select("run_id", "url").limit(0)
        chosen = kept(pick(hits, seen, ["run_id", "angle"], READS_A_SEARCH))
        if not allowed():
            break
        visited = kept(seen.unionByName(chosen.select("run_id", "url")).distinct())
        found = read(chosen)
        new = kept(found if facts is None else found.join(facts, ["run_id", "url", "quote"], "left_anti"))
        facts = new if facts is None else kept(facts.unionByName(new.select(facts.columns)))
        if new.isEmpty() and left == 0:
            break
        if left and allowed():
            left -= 1
            waiting = kept(waiting.unionByName(replan(facts).select(waiting.columns)))
    return facts if facts is not None else read(search(waiting.limit(0)).limit(0))
