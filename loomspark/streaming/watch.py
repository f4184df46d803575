"""Watching pages and healing selectors as keyed state of Structured Streaming."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import diff
from ..operators.diff import word_diff

WATCH_OUTPUT = "url string, seq long, baseline boolean, changed boolean, old_hash string, new_hash string, diff string, words_delta long"


def compare(before: str | None, after: str) -> dict:
    """What one check of a page finds. The first check is the baseline; new spacing alone is no change."""
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    new = digest(after)
    if before is None:
        return {"baseline": True, "changed": False, "old_hash": None, "new_hash": new, "diff": None, "words_delta": 0}
    same = before.split() == after.split()
    try:
        diff = "" if same else "\n".join(word_diff(before, after))
    except ValueError:
        diff = "too large"
    delta = len(after.split()) - len(before.split())
    return {"baseline": False, "changed": not same, "old_hash": digest(before), "new_hash": new, "diff": diff or None, "words_delta": 0 if same else delta}


class Watcher(StatefulProcessor):
    """Keyed by url: holds the last watched text. Rows of other sources than watch do not move the baseline."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "markdown string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # The state is asked and told once a batch, not once a row: each time is a round trip to the store.
        out, known = [], self.last.get()[0] if self.last.exists() else None
        before = known
        for row in sorted((r for pdf in rows for r in pdf.to_dict("records")), key=lambda r: r["seq"]):
            if row.get("source") not in (None, "", "watch"):
                continue
            after = row["markdown"] or ""
            out.append({"url": key[0], "seq": row["seq"], **compare(before, after)})
            before = after
        if before != known:
            self.last.update((before,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in WATCH_OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def watch(versions: DataFrame) -> DataFrame:
    """A row for each check of a stream of page versions (url, seq, source, markdown)."""
    return versions.groupBy("url").transformWithStateInPandas(Watcher(), WATCH_OUTPUT, "append", "none")


HEAL_OUTPUT = "domain string, field string, seq long, null_rate double"
WINDOW, THRESHOLD = 50, 0.30


class Healer(StatefulProcessor):
    """Keyed by domain and field: the ring of the last outcomes, cleared when it calls for healing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "outcomes string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ring = self.ring.get()[0] if self.ring.exists() else ""
        out = []
        for row in sorted((r for pdf in rows for r in pdf.to_dict("records")), key=lambda r: r["seq"]):
            ring = (ring + ("1" if row["is_null"] else "0"))[-WINDOW:]
            rate = ring.count("1") / len(ring)
            if len(ring) >= WINDOW // 5 and rate > THRESHOLD:
                out.append({"domain": key[0], "field": key[1], "seq": row["seq"], "null_rate": rate})
                ring = ""
        self.ring.update((ring,))
        yield pd.DataFrame(out, columns=["domain", "field", "seq", "null_rate"])

    def close(self) -> None:
        pass


def heal_triggers(outcomes: DataFrame) -> DataFrame:
    """A row for each trigger in a stream of outcomes (domain, field, seq, is_null)."""
    return outcomes.groupBy("domain", "field").transformWithStateInPandas(Healer(), HEAL_OUTPUT, "append", "none")


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """Drive a stream over what is there now; returns all its output so far.

    State and output are kept in the folder, so a later run goes on where this one ended, and a run that was
    broken off neither loses nor repeats rows.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state")
    writer.option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def deliver_changes(changes: DataFrame, send) -> None:
    """For foreachBatch: one call of send(Row) for each change of a micro-batch, on the driver, in order."""
    for row in changes.where("changed").orderBy("url", "seq").toLocalIterator():
        send(Row(**row.asDict()))


# The process that sets a stateful operator up gets no shipped package, so these modules travel with it.
for _module in (sys.modules[__name__], diff):
    cloudpickle.register_pickle_by_value(_module)
