"""Deliveries: each line arrives once, whatever fails; signed webhooks with retries; streams."""

import hashlib
import hmac
import json
import os
import subprocess
import sys
import textwrap
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from loomspark.sources import delivery

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def cat_to(path):
    return json.dumps(["sh", "-c", f"cat >> {path}"])


def lines(path):
    return Counter(path.read_text().splitlines()) if path.exists() else Counter()


def test_lines_arrive_once_over_failed_and_repeated_runs(spark, tmp_path):
    rows = spark.createDataFrame([(i % 90, "é\n") for i in range(200)], "i int, `t.x` string")
    out, log = tmp_path / "out", f"file://{tmp_path}/log"
    broken = rows.withColumn("i", F.when((F.col("i") == 41) & F.lit(True), F.raise_error(F.lit("half way")).cast("int")).otherwise(F.col("i")))
    with pytest.raises(Exception, match="half way"):
        delivery.deliver(broken, log, "command", command=cat_to(out))
    with pytest.raises(Exception, match="ended with 3"):
        delivery.deliver(rows, log, "command", command=json.dumps(["sh", "-c", "cat > /dev/null; exit 3"]))
    first = delivery.deliver(rows, log, "command", command=cat_to(out))
    assert first["delivered"] + first["known"] == 200 and first["refused"] == 0
    assert lines(out) == Counter(json.dumps({"i": i % 90, "t.x": "é\n"}, ensure_ascii=False, separators=(",", ":")) for i in range(200))
    assert delivery.deliver(rows, log, "command", command=cat_to(out)) == {"delivered": 0, "refused": 0, "known": 200}
    assert sum(lines(out).values()) == 200
    assert delivery.deliver(rows.limit(0), f"file://{tmp_path}/none", "command", command=cat_to(out)) == {"delivered": 0, "refused": 0, "known": 0}


def test_a_task_that_is_tried_again_sends_the_rest_only(tmp_path):
    """In a session of its own, as tasks are tried once on a plain local master: the first attempts fail after half of their rows."""
    script = f"""
        import json, sys
        sys.path.insert(0, {ROOT!r})
        from pyspark import TaskContext
        from loomspark.session import session
        from loomspark.sources import delivery

        class Failing(delivery.CommandChannel):
            def send(self, message_id, body, log):
                if TaskContext.get().attemptNumber() == 0 and len(self.sent) == 25:
                    raise RuntimeError("half way")
                super().send(message_id, body, log)

        delivery.CHANNELS["failing"] = Failing
        spark = session("retry", spark__master="local[2,3]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
        spark.sparkContext.setLogLevel("OFF")
        print(delivery.deliver(spark.range(200), "file://{tmp_path}/log", "failing", tasks=4, command={cat_to(tmp_path / "out")!r}))
    """
    run = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], capture_output=True, text=True, timeout=150)
    assert "'known': 100" in run.stdout, run.stdout + run.stderr[-2000:]
    assert lines(tmp_path / "out") == Counter(f'{{"id":{i}}}' for i in range(200))


@pytest.fixture
def receiver():
    """A server that answers 503 to the first try of each message with an odd number, 404 to 7, and keeps what it has accepted."""
    tries, accepted = Counter(), []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            own = json.loads(body)["i"]
            tries[own] += 1
            status = 404 if own == 7 else 503 if own % 2 and tries[own] == 1 else 302 if own == 8 else 204
            if status == 204:
                accepted.append((own, dict(self.headers.items()), body))
            self.send_response(status)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/hook?k=v", tries, accepted
    server.shutdown()


def test_webhooks_are_signed_and_tried_again(spark, tmp_path, receiver):
    url, tries, accepted = receiver
    rows = spark.range(20).select(F.col("id").cast("int").alias("i"))
    options = {"url": url, "secret": "s3cret", "pause": "0.01"}
    assert delivery.deliver(rows, f"file://{tmp_path}/log", "webhook", **options) == {"delivered": 18, "refused": 2, "known": 0}
    assert sorted(i for i, _, _ in accepted) == [i for i in range(20) if i not in (7, 8)]
    assert tries[7] == tries[8] == 1 and tries[9] == 2
    for _, headers, body in accepted:
        h = {k.lower(): v for k, v in headers.items()}
        assert h["webhook-id"] == delivery.digest_of(body.decode())
        signed = f"{h['webhook-id']}.{h['webhook-timestamp']}.".encode() + body
        assert h["webhook-signature"] == hmac.new(b"s3cret", signed, hashlib.sha256).hexdigest()
    assert delivery.deliver(rows, f"file://{tmp_path}/log", "webhook", **options)["known"] == 20 and sum(tries.values()) == 29
    with pytest.raises(Exception, match="no answer after 2 tries") as e:
        delivery.deliver(rows, f"file://{tmp_path}/dead", "webhook", url="http://127.0.0.1:9/secret-path", tries="2", pause="0")
    assert "secret-path" not in str(e.value)


def test_streams_deliver_each_batch_once(spark, tmp_path):
    source, out, log = tmp_path / "source", tmp_path / "out", f"file://{tmp_path}/log"
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(source))
        delivery.deliver_stream(stream, log, str(tmp_path / "state"), "command", command=cat_to(out)).trigger(availableNow=True).start().awaitTermination()

    run()
    run()
    assert lines(out) == Counter(f'{{"id":{i}}}' for i in range(30))
    last = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    last.unlink()  # as if the run had ended after sending and before the commit
    (tmp_path / "state" / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert lines(out) == Counter(f'{{"id":{i}}}' for i in range(30))


def test_options_are_checked(spark, tmp_path):
    with pytest.raises(Exception, match="needs a log and a channel"):
        delivery.deliver(spark.range(1), f"file://{tmp_path}", "pigeon")


def test_a_task_gets_no_more_messages_as_deliveries_grow():
    assert [delivery.tasks_for(n) for n in (0, 400_000, 9_000_000)] == [8, 8, 180]


def test_copies_are_told_apart(spark, tmp_path):
    rows = spark.range(90).selectExpr("id % 30 as k")
    out = tmp_path / "out"
    options = {"command": cat_to(out)}
    assert delivery.deliver(rows, f"file://{tmp_path}/log", "command", **options) == {"delivered": 90, "refused": 0, "known": 0}
    assert delivery.deliver(rows, f"file://{tmp_path}/log", "command", **options) == {"delivered": 0, "refused": 0, "known": 90}
