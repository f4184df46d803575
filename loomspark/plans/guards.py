"""Queries for state guards, small predicates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import small, text, urls
from ..operators import ledger
from ..sources.tables import table
from .registry import query


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN TRUE ELSE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' END AS kept FROM orders")
def published_range(spark, sf_dir):
    published = F.when(F.col("o_orderkey") % 9 == 0, F.lit("last spring")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"))
    return table(spark, sf_dir, "orders").select("o_orderkey", small.in_range(published, "1995-01-01", "1996-12-31").alias("kept"))


_SEGMENT = "['Tag', 'search', 'tagged', '', 'LOGIN', 'cart', 'a'][CAST(p_size % 7 AS INTEGER) + 1]"


@query(
    f"""WITH u AS (SELECT p_partkey, list_filter(string_split(lower(CASE WHEN p_size = 50 THEN '/' ELSE '/' || replace(p_type, ' ', '/') || '/' || {_SEGMENT} || '/' || p_partkey END), '/'), lambda x: x <> '') AS s FROM part)
    SELECT p_partkey, len(s) = 0 OR list_has_any(s, ['tag', 'tags', 'category', 'categories', 'author', 'search', 'login', 'signup', 'cart', 'account']) AS low FROM u"""
)
def low_value_paths(spark, sf_dir):
    segment = F.element_at(F.array(*map(F.lit, ("Tag", "search", "tagged", "", "LOGIN", "cart", "a"))), (F.col("p_size") % 7 + 1).cast("int"))
    path = F.concat(F.lit("/"), F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/"), segment, F.lit("/"), F.col("p_partkey").cast("string"))
    url = F.concat(F.lit("http://x.com"), F.when(F.col("p_size") == 50, "/").otherwise(path), F.lit("?search=1#tag"))
    return table(spark, sf_dir, "part").select("p_partkey", small.low_value_path(url).alias("low"))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderkey % 256 AS a, o_custkey % 256 AS b, (o_orderkey // 7) % 4 AS c FROM orders)
    SELECT o_orderkey, NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127)
      OR (a = 198 AND b IN (18, 19)) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) AND o_orderkey % 11 <> 5 AS allowed FROM o"""
)
def fetch_guard(spark, sf_dir):
    """Addresses of all kinds made of order numbers; one in eleven is asked for over a scheme that is not fetched."""
    k = F.col("o_orderkey")
    octets = [k % 256, F.col("o_custkey") % 256, F.floor(k / 7) % 4, F.lit(77)]
    scheme = F.when(k % 11 == 5, "ftp://").when(k % 2 == 0, "http://").otherwise("https://")
    url = F.concat(scheme, F.concat_ws(".", *(o.cast("string") for o in octets)), F.lit(":80/x"))
    return table(spark, sf_dir, "orders").select("o_orderkey", url.alias("url")).select("o_orderkey", small.is_fetch_allowed("url").alias("allowed"))


@query(
    """SELECT p_partkey, 'https://ex' || (p_size % 9) || '.com/' || CASE p_partkey % 6 WHEN 0 THEN 'a' || p_size || '/d' || p_partkey WHEN 1 THEN 'e' || p_partkey WHEN 2 THEN 'a' || p_size || '/b/c?q=' || p_partkey
      WHEN 3 THEN 'a' || p_size || '/b/f/h' || p_partkey WHEN 4 THEN 'a' || p_size || '/b/c?x=1' ELSE p_partkey || '/' END AS resolved FROM part"""
)
def resolve_urls(spark, sf_dir):
    size, number = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    base = F.concat(F.lit("https://ex"), (F.col("p_size") % 9).cast("string"), F.lit(".com/a"), size, F.lit("/b/c?x=1"))
    forms = (F.concat(F.lit("../d"), number), F.concat(F.lit(" /e"), number, F.lit("#top ")), F.concat(F.lit("?q="), number), F.concat(F.lit("f/./g/../h"), number), F.lit("#only"), F.concat(F.lit("../../../"), number, F.lit("/")))
    href = F.element_at(F.array(*forms), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", urls.resolve(base, href).alias("resolved"))


@query("SELECT o_orderkey, CASE WHEN p IS NULL THEN s = 'launch' WHEN s IN ('running', 'failed') THEN p IN ('launch', 'running', 'writing') WHEN s = 'done' THEN p IN ('writing', 'running') ELSE FALSE END AS valid FROM (SELECT o_orderkey, s, lag(s) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'launch' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS s FROM orders))")
def run_state_guard(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("launch", "running", "done", "failed"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    log = table(spark, sf_dir, "orders").withColumn("status", status)
    return ledger.valid_transitions(log, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "valid")


@query(
    """WITH v AS (SELECT l_orderkey AS run_id, CAST(l_linenumber % 3 AS VARCHAR) AS fact_id, l_partkey * 10 + l_linenumber AS seq, CASE WHEN l_quantity > 30 THEN 'verified' WHEN l_quantity > 20 THEN 'softened' WHEN l_quantity > 10 THEN 'contested' ELSE 'unverified' END AS status,
      CASE WHEN l_quantity > 25 THEN 'n' || l_partkey ELSE '' END AS note FROM lineitem),
    good AS (SELECT run_id, fact_id, arg_min(status, (seq, status, note)) AS status, arg_min(note, (seq, status, note)) AS note FROM v WHERE status <> 'unverified' AND (status <> 'softened' OR note <> '') GROUP BY 1, 2),
    f AS (SELECT DISTINCT l_orderkey AS run_id, CAST(l_linenumber % 3 AS VARCHAR) AS fact_id FROM lineitem)
    SELECT f.run_id, f.fact_id, COALESCE(g.status, 'unverified') AS status, CASE WHEN g.run_id IS NULL THEN 'none' ELSE g.note END AS note FROM f LEFT JOIN good g USING (run_id, fact_id)"""
)
def fact_verdicts(spark, sf_dir):
    q = F.col("l_quantity")
    status = F.when(q > 30, "verified").when(q > 20, "softened").when(q > 10, "contested").otherwise("unverified")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") % 3).cast("string").alias("fact_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"), status.alias("status"), F.when(q > 25, F.concat(F.lit("n"), F.col("l_partkey").cast("string"))).otherwise("").alias("note"))
    facts = rows.select("run_id", "fact_id").distinct().withColumns({"status": F.lit("unverified"), "note": F.lit("none")})
    return ledger.apply_verdicts(facts, rows, "seq")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'done' ELSE 'pending' END AS status FROM orders")
def crawl_resume(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "P", "inflight").when(F.col("o_orderstatus") == "F", "done").otherwise("pending")
    return ledger.resume(table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status")))


@query("SELECT DISTINCT l_partkey AS url_hash FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def enqueue_new(spark, sf_dir):
    queue = table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("url_hash"))
    return ledger.enqueue(queue, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("url_hash")))


@query("SELECT event_id, greatest(0.0::DOUBLE, (ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 3) / 2.0::DOUBLE) AS earliest FROM events")
def rate_schedule(spark, sf_dir):
    return ledger.schedule(table(spark, sf_dir, "events"), "user_id", ["event_id"], rate=2.0).select("event_id", "earliest")


@query("SELECT event_id, issue, CASE WHEN issue IN ('login-required', 'robots', 'empty') THEN issue ELSE 'error' END AS bucket, detail FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'login-required' WHEN 'click' THEN 'robots' WHEN 'error' THEN 'empty' ELSE 'timeout' END AS issue, CASE WHEN event_id % 2 = 0 THEN 'host: ' || user_id ELSE '' END AS detail FROM events)")
def unreadable_buckets(spark, sf_dir):
    issue = F.when(F.col("event_type") == "view", "login-required").when(F.col("event_type") == "click", "robots").when(F.col("event_type") == "error", "empty").otherwise("timeout")
    message = F.when(F.col("event_id") % 2 == 0, F.concat(issue, F.lit(": host: "), F.col("user_id").cast("string"))).otherwise(issue)
    parts = small.split_issue(message)
    return table(spark, sf_dir, "events").select("event_id", parts["issue"].alias("issue"), small.issue_bucket(message).alias("bucket"), parts["detail"].alias("detail"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1) THEN 'v' || p_partkey END AS video, CASE WHEN p_partkey % 5 = 2 THEN 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS asin,
    CASE WHEN p_partkey % 5 = 3 THEN CAST(1000000 + p_partkey AS VARCHAR) END AS item, CASE WHEN p_partkey % 5 = 4 THEN '@s/p' || p_partkey END AS package FROM part"""
)
def url_ids(spark, sf_dir):
    n, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 5
    url = (
        F.when(k == 0, F.concat(F.lit("https://www.youtube.com/watch?a=b&v=v"), n))
        .when(k == 1, F.concat(F.lit("https://youtu.be/v"), n))
        .when(k == 2, F.concat(F.lit("https://www.amazon.com/x/dp/B"), F.lpad(n, 9, "0")))
        .when(k == 3, F.concat(F.lit("https://www.ebay.com/itm/a-b/"), (F.col("p_partkey") + 1000000).cast("string")))
        .otherwise(F.concat(F.lit("https://www.npmjs.com/package/@s/p"), n))
    )
    return table(spark, sf_dir, "part").select("p_partkey", small.url_ids(url).alias("i")).select("p_partkey", "i.*")


@query(
    """WITH w AS (SELECT p_partkey, list_distinct(string_split(p_name || ' ' || p_brand, ' ')) AS a, list_distinct(string_split(p_brand || ' ' || p_type, ' ')) AS b FROM part)
    SELECT p_partkey, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE, 9) AS j FROM w"""
)
def class_jaccard(spark, sf_dir):
    words = lambda *c: F.array_distinct(F.split(F.concat_ws(" ", *c), " "))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(small.jaccard(words("p_name", "p_brand"), words("p_brand", "p_type")), 9).alias("j"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS complete, o_orderkey % 2 = 0 AS slow FROM orders")
def required_fields(spark, sf_dir):
    record = F.to_json(F.struct(F.col("o_orderstatus").alias("a"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("b")))
    document = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("x"))).otherwise(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("y")))
    fields = F.array(F.lit("a"), F.lit("b"))
    return table(spark, sf_dir, "orders").select("o_orderkey", small.all_present(record, ["a", "b"]).alias("complete"), small.needs_slow_path(fields, document).alias("slow"))


_LEAD, _TAIL = "See [link](http://x/y) now [^1] and ![i](http://x/z.png) https://a.b/c ", " <b>end</b> [1]: http://x/q"
#: The same steps as they are defined: images, links, reference definitions, footnote marks, tags, bare addresses.
_STEPS = ((r"!\[([^\]]*)\]\(([^)]+)\)", ""), (r"\[([^\]]*)\]\(([^)]+)\)", r"\1"), (r"(?m)^\[[^\]]+\]:\s.*$", ""), (r"\[\^[^\]]+\]", ""), (r"<[^>]+>", ""), (r"https?://\S+", ""))
_UNLINKED = f"'{_LEAD}' || text || '{_TAIL}'"
for _pattern, _left in _STEPS:
    _UNLINKED = f"regexp_replace({_UNLINKED}, '{_pattern}', '{_left}', 'g')"


@query(f"SELECT doc_id, md5(trim({_UNLINKED})) AS plain FROM documents")
def unlinked_report(spark, sf_dir):
    report = F.concat(F.lit(_LEAD), F.col("text"), F.lit(_TAIL))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(small.unlinked(report)).alias("plain"))


@query("SELECT p_partkey, regexp_replace(p_brand || ' ' || p_name, '[^A-Za-z0-9_-]', '', 'g') AS css, left(p_name, 5) AS cut FROM part")
def css_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.css_identifier(F.concat_ws(" ", "p_brand", "p_name")).alias("css"), F.left("p_name", F.lit(5)).alias("cut"))


@query("SELECT p_partkey, p_brand AS field, p_size / 100.0::DOUBLE AS null_rate FROM part UNION ALL SELECT p_partkey, 'name', 0.0::DOUBLE FROM part")
def selector_report(spark, sf_dir):
    fields = F.create_map(F.col("p_brand"), F.col("p_size") / F.lit(100.0), F.lit("name"), F.lit(0.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(fields).alias("field", "null_rate"))


@query("SELECT p_brand AS query, CAST(rank AS INTEGER) AS rank, p_partkey, CASE WHEN rank <= 3 THEN 'page ' || p_partkey END AS page FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank FROM part)")
def hits_with_pages(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    hits = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query"), rank.alias("rank"), "p_partkey")
    pages = hits.select("query", "rank", F.concat(F.lit("page "), F.col("p_partkey").cast("string")).alias("page"))
    return ledger.attach_pages(hits, pages, 3)


@query("SELECT p_partkey FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50)")
def selector_evict(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return ledger.evict(parts, parts.where("p_size = 50"), ["p_brand"]).select("p_partkey")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'side' || chr(10) || chr(10) || o_orderpriority WHEN 1 THEN o_orderpriority WHEN 2 THEN 'side' || chr(10) || chr(10) || o_orderpriority || chr(10) || chr(10) || 'ask' ELSE o_orderpriority || chr(10) || chr(10) || 'ask' END AS prompt FROM orders")
def prompt_parts(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    side, extra = F.when(k % 2 == 0, F.lit("side")), F.when(k >= 2, F.lit("ask")).otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", small.prompt(side, F.col("o_orderpriority"), extra).alias("prompt"))
