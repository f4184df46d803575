"""Queries over mechanisms that run across many rows: record files, request pacing, healing in a stream, deliveries, extractors."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ..operators import modules, pacing
from ..session import shared_dir
from ..sources import delivery, records, xml
from ..sources.tables import table
from ..streaming.heal import PAGES, HealingStream
from .registry import query


@query("SELECT doc_id, lang, n_chars, md5(text) AS text FROM documents")
def json_array_records(spark, sf_dir):
    """Documents, written as arrays on one line each and read again."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(["["])], names=["value"])
        last = None
        for batch in batches:
            lines = ([] if last is None else [last]) + batch.column(0).to_pylist()
            last = lines.pop() if lines else None
            yield pa.RecordBatch.from_arrays([pa.array([x + "," for x in lines], pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if last is None else last + "]"])], names=["value"])

    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    fields = table(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "lang", "n_chars", "text")).alias("value"))
    fields.mapInArrow(arrays, "value string").write.option("lineSep", " ").text(path)
    read = records.read_records(spark, path).select(F.from_json("record", "doc_id long, lang string, n_chars long, text string").alias("r"))
    return read.select("r.doc_id", "r.lang", "r.n_chars", F.md5("r.text").alias("text"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, (CAST(floor(epoch(ts)) AS BIGINT) // 900) / 4.0::DOUBLE AS hours, event_type, value FROM events),
    events_and_delays AS (
      SELECT user_id, hours, 1 AS request, 0.0::DOUBLE AS delay, event_id FROM e
      UNION ALL SELECT user_id, hours, 0, CASE WHEN event_id % 3 = 0 THEN 2.0::DOUBLE ELSE 8.0::DOUBLE END, event_id FROM e WHERE event_type = 'error' AND value > 60),
    o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY hours, request, event_id) AS n FROM events_and_delays),
    f AS (
      SELECT user_id, 0::BIGINT AS n, NULL::DOUBLE AS hours, 3.0::DOUBLE AS tokens, 4.0::DOUBLE AS gap, NULL::BIGINT AS event_id, 0 AS request FROM (SELECT DISTINCT user_id FROM o)
      UNION ALL SELECT o.user_id, o.n, o.hours, LEAST(3.0::DOUBLE, f.tokens + COALESCE(o.hours - f.hours, 0.0::DOUBLE) / f.gap) - o.request, GREATEST(f.gap, o.delay), o.event_id, o.request
      FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
    SELECT event_id, hours, GREATEST(0.0::DOUBLE, -tokens) * gap AS wait, hours + GREATEST(0.0::DOUBLE, -tokens) * gap AS starts FROM f WHERE request = 1"""
)
def rate_admissions(spark, sf_dir):
    """Events as requests to their user's host, with a bucket of three at one in four hours, and delays that errors ask for."""
    hours = F.floor(F.unix_timestamp("ts") / 900) / 4.0
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), hours.alias("at"), "event_id", "event_type", "value")
    delays = events.where("event_type = 'error' AND value > 60").select("host", "at", F.when(F.col("event_id") % 3 == 0, 2.0).otherwise(8.0).alias("delay"))
    return pacing.admissions(events.select("host", "at", "event_id"), delays, "event_id", rate=0.25).select("event_id", F.col("at").alias("hours"), "wait", "starts")


@query("SELECT p_partkey AS seq, p_brand AS domain, CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE CAST(p_retailprice AS DOUBLE) END AS price, CASE WHEN p_partkey % 4 < 2 THEN 0 ELSE 2 END AS since FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING COUNT(*) FILTER (p_partkey % 4 = 1) >= 10)")
def healing_stream(spark, sf_dir):
    """Parts as pages of their brand's site, in four batches; the template changes with the second, whose prices are lost until it has healed."""
    part = table(spark, sf_dir, "part")
    batch, price = F.col("p_partkey") % 4, F.col("p_retailprice").cast("string")
    box = F.when(batch == 0, F.concat(F.lit('<div class="offer"><span class="price">'), price, F.lit("</span></div>")))
    box = box.otherwise(F.concat(F.lit('<div class="offer"><p><b class="price amount">'), price, F.lit("</b></p></div>")))
    html = F.concat(F.lit("<html><body><h1>"), "p_name", F.lit("</h1>"), box, F.lit("</body></html>"))
    truth = F.to_json(F.struct(F.col("p_retailprice").alias("price")))
    enough = part.where(batch == 1).groupBy("p_brand").count().where("count >= 10").select("p_brand")
    pages = part.join(enough, "p_brand", "left_semi").select(F.col("p_brand").alias("domain"), F.col("p_partkey").alias("seq"), html.alias("html"), truth.alias("truth"), batch.alias("batch"))
    folder = f"{shared_dir(spark)}/healing-{uuid.uuid4().hex}"
    for n in range(4):  # in this order
        pages.where(F.col("batch") == n).drop("batch").coalesce(1).write.mode("append").parquet(f"{folder}/pages")
    fields = json.dumps({"price": {"type": "css", "expr": "span.price", "coerce": "float"}})
    run = HealingStream(spark, folder, {"price": {"coerce": "float"}})
    run.begin(pages.select("domain").distinct().select("domain", F.lit(fields).alias("fields"), F.lit(None).cast("string").alias("fingerprints")))
    records = run.run(spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/pages"))
    return records.select("seq", "domain", F.get_json_object("record", "$.price").cast("double").alias("price"), F.col("since").cast("int").alias("since"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus, 1 AS times FROM orders")
def delivered_once(spark, sf_dir):
    """Orders, sent to a process that keeps its lines, by a run that is broken off and by one that goes on: how often each arrived."""
    folder = f"{shared_dir(spark)}/delivery-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    last, count = orders.agg(F.max("o_orderkey"), F.count("*")).first()
    broken = orders.where(F.when(F.col("o_orderkey") == last, F.raise_error(F.lit("broken off")).cast("boolean")).otherwise(True))
    inbox = folder.removeprefix("file:").replace("//", "/") + "/inbox"
    keep_lines = json.dumps(["sh", "-c", f"mkdir -p {inbox} && cat > {inbox}/$$-$(date +%s%N)"])
    for rows in (broken, orders):
        try:
            delivery.deliver(rows, f"{folder}/log", "command", delivery.tasks_for(count), command=keep_lines)
        except PySparkException as e:
            if "broken off" not in str(e):
                raise
    lines = spark.read.schema("o_orderkey long, o_orderstatus string").json(f"{folder}/inbox")
    return lines.groupBy("o_orderkey", "o_orderstatus").agg(F.count("*").cast("int").alias("times"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN p_name END AS name, CASE WHEN p_size % 7 > 0 THEN p_size || '.0' END AS version, CASE WHEN p_size % 7 > 0 THEN p_type END AS summary,
    CASE WHEN p_size % 7 = 0 THEN 'no data' END AS error FROM part"""
)
def extract_table(spark, sf_dir):
    """Parts as answers of a package index, read by the table function."""
    info = F.to_json(F.struct(F.struct(F.col("p_name").alias("name"), F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("version"), F.col("p_type").alias("summary")).alias("info")))
    body = F.when(F.col("p_size") % 7 > 0, info).otherwise("<html>not found</html>")
    url = F.concat(F.lit("https://pypi.org/project/p"), F.col("p_partkey").cast("string"))
    modules.register_functions(spark)
    rows = table(spark, sf_dir, "part").select("p_partkey", url.alias("url"), body.alias("body"))
    return spark.sql("SELECT p_partkey, name, version, summary, error FROM extract('pypi', TABLE({rows}))", rows=rows)


@query(
    """SELECT p_partkey, p_name || ' & co' AS title, 'http://h/' || p_size AS link, [{'title': p_type, 'link': 'http://h/i/' || p_partkey, 'published': CAST(p_size AS VARCHAR), 'summary': p_brand || ' <3'},
      {'title': p_brand, 'link': 'http://h/j', 'published': NULL, 'summary': NULL}] AS items FROM part"""
)
def feed_items(spark, sf_dir):
    """Parts as feeds, by turns RSS and Atom with prefixes, CDATA and entities; items are its entries in order."""
    name, size, kind, brand, key = (F.col(c).cast("string") for c in ("p_name", "p_size", "p_type", "p_brand", "p_partkey"))
    join = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    rss = join(
        "<?xml version='1.0'?><!-- <feed> --><rss version='2.0' xmlns:atom='http://www.w3.org/2005/Atom'><channel><atom:link rel='self' href='http://self'/><title>", name, " &amp; co</title>",
        "<atom:link href='http://h/", size, "'/><item><title> ", kind, "\n</title><link>http://h/i/", key, "</link><pubDate>", size, "</pubDate><description><![CDATA[<b>", brand, "</b> <3]]></description></item>",
        "<item><title>", brand, "</title><link>http://h/j</link></item></channel></rss>",
    )
    atom = join(
        '<a:feed xmlns:a = "http://www.w3.org/2005/Atom"><a:title type="html">', name, " &#38; co</a:title><a:link href='http://h/", size, "' rel='alternate'/><a:entry><a:link rel='edit' href='http://e'/><a:link href='http://h/i/", key, "'/><a:title>", kind,
        "</a:title><a:updated>", size, "</a:updated><a:content><![CDATA[", brand, " <3]]></a:content></a:entry><a:entry><a:title>", brand, '</a:title><a:link href="http://h/j"/></a:entry></a:feed>',
    )
    bodies = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, rss).otherwise(atom).alias("body"))
    return xml.feeds(bodies, "body").select("p_partkey", "feed.title", "feed.link", "feed.items")
