"""Writers: JSONL, one JSON array, csv, partitioned records, subprocesses, signed webhooks."""

from __future__ import annotations

import hashlib
import hmac
import subprocess
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import csv_cell


def envelope(records: DataFrame, keep: list[str] | None = None, corpus: bool = False) -> DataFrame:
    """line: a JSON object {url, extracted}, or {url, title, depth, markdown} of a corpus."""
    fields = ("url", "title", "depth", "markdown") if corpus else ("url", "extracted")
    return records.select(*(keep or []), F.to_json(F.struct(*fields)).alias("line"))


def write_jsonl(records: DataFrame, path: str, corpus: bool = False) -> None:
    envelope(records, corpus=corpus).select("line").write.text(path)


def json_array(records: DataFrame) -> str:
    """All records as one JSON array on the driver: for small results that a caller asked for in one piece."""
    return "[" + ",".join(r.line for r in records.select(F.to_json(F.struct(*records.columns)).alias("line")).toLocalIterator()) + "]"


def csv_columns(fields: list[str], required: list[str]) -> list[str]:
    """Required fields in their order, then the others sorted."""
    return [*required, *sorted(set(fields) - set(required))]


def write_csv(records: DataFrame, path: str, required: list[str]) -> None:
    """A header and defused cells; TypeError for nested columns, before anything is read."""
    nested = [f.name for f in records.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if nested:
        raise TypeError(f"csv has no nested values: {', '.join(nested)}")
    columns = csv_columns(records.columns, required)
    records.select(*(csv_cell(F.col(c).cast("string")).alias(c) for c in columns)).write.csv(path, header=True)


def write_records(records: DataFrame, path: str) -> None:
    """Append (run_id, url, record_json, ts), by run."""
    records.write.mode("append").partitionBy("run_id").parquet(path)


def pipe_to(records: DataFrame, command: list[str]) -> DataFrame:
    """Each partition's JSON lines go to one process's standard input; a bad exit fails the task. Returns lines sent."""

    def send(batches: Iterator) -> Iterator:
        import pyarrow as pa

        process, n = subprocess.Popen(command, stdin=subprocess.PIPE), 0
        for batch in batches:
            for line in batch.column(0).to_pylist():
                process.stdin.write(line.encode() + b"\n")
                n += 1
        process.stdin.close()
        if process.wait():
            raise RuntimeError(f"{command[0]} ended with {process.returncode}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["sent"])

    return records.select(F.to_json(F.struct(*records.columns)).alias("line")).mapInArrow(send, "sent long")


def sign(secret: bytes, message_id: str, timestamp: int, body: bytes) -> str:
    """HMAC-SHA256, in hex, over id.timestamp.body."""
    return hmac.new(secret, f"{message_id}.{timestamp}.".encode() + body, hashlib.sha256).hexdigest()


RETRIED = (408, 429)


def deliver(post: Callable[[dict, bytes], int], message_id: str, body: bytes, secret: bytes | None, now: int, tries: int = 4, pause: Callable[[float], None] = lambda s: None) -> tuple[bool, int]:
    """Send a change once: (delivered, tries). 408, 429 and 5xx are tried again with growing pauses; others are final.

    post takes headers and a body and returns a status; the message's id is the same in every try.
    """
    headers = {"webhook-id": message_id, "webhook-timestamp": str(now)}
    if secret:
        headers["webhook-signature"] = sign(secret, message_id, now, body)
    for n in range(1, tries + 1):
        status = post(headers, body)
        if 200 <= status < 300:
            return True, n
        if status not in RETRIED and not 500 <= status < 600:
            return False, n
        if n < tries:
            pause(0.5 * 2 ** (n - 1))
    return False, tries
