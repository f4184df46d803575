"""Delivery of rows to processes and webhooks from the executors, which a retried task does not repeat.

`deliver` and `deliver_stream` write through a Spark data source. Rows are dealt to tasks by a hash of their content, so a row is in the
same task in every attempt, and have a message id from their content (and their number, where rows are alike). A task logs the ids
that were received in files of its own below `log`; the next attempt of the task, or a later run with the same log,
reads them and sends the rest only. The log is written every FLUSH messages and whenever a task fails, so only a
machine that dies takes up to FLUSH entries with it; their messages come again with the same id, by which a receiver can tell. When all
tasks are done the writer commits a summary; an aborted write leaves the logs and no summary. A stream's batches log apart.

Channels: a command gets the lines of a task on its standard input and has received them once it ends with 0; a webhook gets a
signed POST a message, 408, 429, 5xx and broken connections are tried again, and any other answer than 2xx is final: the message is
logged as refused, and counted. Errors do not name the address. Speculative tasks would send twice, so they are refused.
"""

from __future__ import annotations

import hashlib
import http.client
import json
import subprocess
import sys
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from . import sinks

NAME = "loomspark_delivery"
FLUSH = 64
#: Entries of a command's log that are written at once, and the messages that a task should get at most.
LOGGED, A_TASK = 10_000, 50_000
SUMMARY = "_SUMMARY.json"


class DeliveryError(RuntimeError):
    """A command that failed, or a receiver that could not be reached."""


class Log:
    """Ids and whether they were accepted, in files of their own for each attempt of a task, in any store that pyarrow can open."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.attempt, self.files, self.waiting, self.refused = uuid.uuid4().hex, 0, [], 0

    def read(self) -> dict[str, bool]:
        from pyarrow import fs

        known: dict[str, bool] = {}
        for info in self.store.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            with self.store.open_input_stream(info.path) as f:
                known |= {i: ok == "1" for ok, i in (line.split(" ", 1) for line in f.read().decode().splitlines())}
        return known

    def add(self, ids: list[str], accepted: bool) -> None:
        self.waiting += [f"{int(accepted)} {i}" for i in ids]
        self.refused += 0 if accepted else len(ids)
        if len(self.waiting) >= FLUSH:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            self.store.create_dir(self.folder, recursive=True)
            with self.store.open_output_stream(f"{self.folder}/{self.attempt}-{self.files}") as f:
                f.write("\n".join(self.waiting).encode())
            self.files, self.waiting = self.files + 1, []


class CommandChannel:
    def __init__(self, options: dict[str, str]):
        self.command, self.process, self.sent = json.loads(options["command"]), None, []

    def send(self, message_id: str, body: str, log: Log) -> None:
        if self.process is None:
            self.process = subprocess.Popen(self.command, stdin=subprocess.PIPE)
        self.sent.append(message_id)
        try:
            self.process.stdin.write(body.encode() + b"\n")
        except BrokenPipeError:
            pass  # how it ended tells

    def close(self, log: Log) -> None:
        """Wait for the end, which says whether what was sent has been received; also after a failure elsewhere."""
        if self.process is None:
            return
        try:
            self.process.stdin.close()
        except BrokenPipeError:
            pass
        code, self.process = self.process.wait(), None
        if code:
            raise DeliveryError(f"{self.command[0]} ended with {code}")
        for at in range(0, len(self.sent), LOGGED):
            log.add(self.sent[at : at + LOGGED], True)


class WebhookChannel:
    def __init__(self, options: dict[str, str]):
        self.url, self.secret = urlsplit(options["url"]), options.get("secret", "").encode() or None
        self.tries, self.pause, self.timeout = int(options.get("tries", 4)), float(options.get("pause", 0.5)), float(options.get("timeout", 10))

    def post(self, headers: dict, body: bytes) -> int:
        kind = http.client.HTTPSConnection if self.url.scheme == "https" else http.client.HTTPConnection
        connection = kind(self.url.hostname, self.url.port, timeout=self.timeout)
        try:
            target = (self.url.path or "/") + ("?" + self.url.query if self.url.query else "")
            connection.request("POST", target, body, {"Content-Type": "application/json", **headers})
            return connection.getresponse().status
        except (OSError, http.client.HTTPException):
            return 503
        finally:
            connection.close()

    def send(self, message_id: str, body: str, log: Log) -> None:
        last = []

        def post(headers: dict, data: bytes) -> int:
            last[:] = [self.post(headers, data)]
            return last[0]

        accepted, _ = sinks.deliver(post, message_id, body.encode(), self.secret, int(time.time()), self.tries, lambda s: time.sleep(s * 2 * self.pause))
        if not accepted and (last[0] in sinks.RETRIED or last[0] >= 500):
            raise DeliveryError(f"no answer after {self.tries} tries, the last {last[0]}")
        log.add([message_id], accepted)

    def close(self, log: Log) -> None:
        pass


CHANNELS = {"command": CommandChannel, "webhook": WebhookChannel}


@dataclass
class Sent(WriterCommitMessage):
    delivered: int
    refused: int
    known: int


def _send(rows: Iterator[Row], options: dict[str, str], folder: str) -> Sent:
    """Send a task's rows (id, body)."""
    log = Log(f"{folder}/part-{TaskContext.get().partitionId():05d}")
    before = log.read()
    channel = CHANNELS[options["channel"]](options)
    copies, known, sent = Counter(), 0, 0  # alike rows are in one task, and it does not matter which of them is which
    try:
        for row in rows:
            message_id = f"{row.id}-{copies[row.id]}" if copies[row.id] else row.id
            copies[row.id] += 1
            if message_id in before:
                known += 1
                continue
            channel.send(message_id, row.body, log)
            sent += 1
    finally:
        try:
            channel.close(log)
        finally:
            log.flush()
    return Sent(sent - log.refused, log.refused, known)


def _summary(folder: str, messages: list[Sent | None]) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    counts = {n: sum(getattr(m, n) for m in messages if m) for n in ("delivered", "refused", "known")}
    with store.open_output_stream(f"{path}/{SUMMARY}") as f:
        f.write(json.dumps(counts).encode())


class DeliveryWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.options, self.folder = options, options["log"]

    def write(self, iterator: Iterator[Row]) -> Sent:
        return _send(iterator, self.options, self.folder)

    def commit(self, messages: list[Sent | None]) -> None:
        _summary(self.folder, messages)

    def abort(self, messages: list[Sent | None]) -> None:
        pass  # the logs stay, so that another run goes on from them


class DeliveryStreamWriter(DataSourceStreamWriter):
    def __init__(self, options: dict[str, str]):
        self.options, self.folder = options, options["log"]

    def write(self, iterator: Iterator[Row]) -> Sent:
        batch = TaskContext.get().getLocalProperty("streaming.sql.batchId")
        return _send(iterator, self.options, f"{self.folder}/batch={batch}")

    def commit(self, messages: list[Sent | None], batchId: int) -> None:
        _summary(f"{self.folder}/batch={batchId}", messages)

    def abort(self, messages: list[Sent | None], batchId: int) -> None:
        pass


class Delivery(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _checked(self) -> dict[str, str]:
        # Options come in small letters.
        if self.options.get("channel") not in CHANNELS or not self.options.get("log"):
            raise ValueError(f"a delivery needs a log and a channel, one of {', '.join(CHANNELS)}")
        return dict(self.options)

    def writer(self, schema, overwrite: bool) -> DeliveryWriter:
        return DeliveryWriter(self._checked())

    def streamWriter(self, schema, overwrite: bool) -> DeliveryStreamWriter:
        return DeliveryStreamWriter(self._checked())


def _messages(rows: DataFrame, tasks: int) -> DataFrame:
    spark = rows.sparkSession
    if spark.sparkContext.getConf().get("spark.speculation", "false").lower() == "true":
        raise ValueError("with spark.speculation two attempts of a task would send at once")
    spark.dataSource.register(Delivery)
    body = rows.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("body"))
    return body.select(F.left(F.sha2("body", 256), F.lit(32)).alias("id"), "body").repartition(tasks, "id")


def tasks_for(messages: int) -> int:
    """How many tasks keep the ids that one of them holds few: those it has sent, and those of earlier runs."""
    return max(8, -(-messages // A_TASK))


def deliver(rows: DataFrame, log: str, channel: str, tasks: int = 8, **options: str) -> dict[str, int]:
    """Send each of rows as a line of JSON, once, and return how many were delivered, refused, and known from an earlier run.

    log: the folder of this delivery, which all machines can open; with the same log, rows that were received are not sent again,
    so the number of tasks must stay too; tasks_for() says how many many rows need. channel: `command` (command, a JSON list) or `webhook` (url, and secret, tries, pause, timeout).
    """
    writer = _messages(rows, tasks).write.format(NAME).mode("append").option("log", log).option("channel", channel)
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.save()
    return summary(log)


def deliver_stream(rows: DataFrame, log: str, checkpoint: str, channel: str, tasks: int = 8, **options: str):
    """The same for a stream: returns the writer of a streaming query, to be started; its batches log apart."""
    writer = _messages(rows, tasks).writeStream.format(NAME).outputMode("append").option("checkpointLocation", checkpoint).option("log", log).option("channel", channel)
    for k, v in options.items():
        writer = writer.option(k, v)
    return writer


def summary(log: str) -> dict[str, int]:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(log)
    with store.open_input_stream(f"{path}/{SUMMARY}") as f:
        return json.loads(f.read())


def digest_of(body: str) -> str:
    """The id of a message that is not a copy of another."""
    return hashlib.sha256(body.encode()).hexdigest()[:32]


# The process that sets a Python data source up gets no shipped package, so these modules travel with it.
for _module in (sys.modules[__name__], sinks):
    cloudpickle.register_pickle_by_value(_module)
