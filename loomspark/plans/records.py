"""Queries over the ledger: record differences, runs, calls, snapshots, facts, ranked lists, evidence, costs.

The driver's tables stand in for the ledger's: orders for record sets and runs, events for visits, versions and checks,
documents and benchmark for pages and quotes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify
from ..operators import evidence, ledger, rank, recdiff
from ..sources.tables import table
from .registry import query

# Two versions of the orders: some only before, some only after, some with another price or priority.
_SIDES = """prev AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority FROM orders WHERE o_orderkey % 11 <> 0),
cur AS (SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN '  ' || replace(o_orderpriority, '-', ' - ') ELSE ' ' || o_orderpriority || ' ' END AS priority FROM orders WHERE o_orderkey % 17 <> 0)"""
_CHANGED = """(p.price IS DISTINCT FROM c.price OR trim(p.priority) IS DISTINCT FROM trim(c.priority))"""


def _sides(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    base = [k.alias("id"), F.col("o_orderstatus").alias("status")]
    prev = orders.where(k % 11 != 0).select(*base, F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    priority = F.when(k % 13 == 0, F.lit(None)).when(k % 5 == 0, F.concat(F.lit("  "), F.replace("o_orderpriority", F.lit("-"), F.lit(" - ")))).otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
    price = F.when(k % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return prev, orders.where(k % 17 != 0).select(*base, price.alias("price"), priority.alias("priority"))


@query(
    f"""WITH {_SIDES} SELECT COUNT(*) FILTER (WHERE p.id IS NULL) AS added, COUNT(*) FILTER (WHERE p.id IS NOT NULL AND c.id IS NOT NULL AND {_CHANGED}) AS changed,
    COUNT(*) FILTER (WHERE c.id IS NULL) AS gone FROM prev p FULL JOIN cur c ON p.id = c.id"""
)
def recdiff_summary(spark, sf_dir):
    return recdiff.counts(recdiff.row_kinds(*_sides(spark, sf_dir), "id"))


@query(
    f"""WITH {_SIDES}, k AS (SELECT CAST(COALESCE(p.id, c.id) AS VARCHAR) AS key, CASE WHEN p.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'gone' ELSE 'changed' END AS kind
      FROM prev p FULL JOIN cur c ON p.id = c.id WHERE p.id IS NULL OR c.id IS NULL OR {_CHANGED}),
    r AS (SELECT key, kind, CASE kind WHEN 'added' THEN 0 WHEN 'changed' THEN 1 ELSE 2 END AS kind_rank FROM k)
    SELECT key, kind, CAST(kind_rank AS INTEGER) AS kind_rank FROM r ORDER BY kind_rank, key LIMIT 200"""
)
def recdiff_rows(spark, sf_dir):
    return recdiff.ordered_rows(recdiff.row_kinds(*_sides(spark, sf_dir), "id"), 200)


@query(
    f"""WITH {_SIDES}, b AS (SELECT CAST(p.id AS VARCHAR) AS key, p.priority AS a, c.priority AS b, p.price AS x, c.price AS y FROM prev p JOIN cur c ON p.id = c.id)
    SELECT key, 'priority' AS path, trim(a) AS old, COALESCE(trim(b), 'null') AS "new", FALSE AS "long" FROM b WHERE trim(a) IS DISTINCT FROM trim(b)
    UNION ALL SELECT key, 'price', NULL, NULL, FALSE FROM b WHERE x <> y"""
)
def recdiff_fields(spark, sf_dir):
    changes = recdiff.field_changes(*_sides(spark, sf_dir), "id")
    shown = lambda c: F.when(F.col("path") != "price", F.col(c)).alias(c)
    return changes.select("key", "path", shown("old"), shown("new"), "long")


@query(
    """WITH i AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, CASE WHEN l_linenumber = 2 THEN l_quantity + 1 ELSE l_quantity END AS b FROM lineitem),
    d AS (SELECT l_orderkey, l_linenumber, MAX(a) AS a, MAX(b) AS b FROM i GROUP BY ALL)
    SELECT COUNT(*) FILTER (WHERE a <> b) AS changed, COUNT(*) AS items FROM d"""
)
def recdiff_items(spark, sf_dir):
    """Records exploded from an array inside a parent record, keyed within it."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    tasks = recdiff.tasks_for(lines)
    items = lines.repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("items"))
    each = items.select("l_orderkey", F.explode("items").alias("i")).select("l_orderkey", "i.l_linenumber", "i.l_quantity")
    one = each.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("a"))
    key = F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id")
    prev = one.select(key, F.col("a").alias("q"))
    cur = one.select(key, F.when(F.col("l_linenumber") == 2, F.col("a") + 1).otherwise(F.col("a")).alias("q"))
    kinds = recdiff.row_kinds(prev, cur, "id", tasks=tasks)
    return kinds.agg(F.count("*").alias("changed")).crossJoin(prev.agg(F.count("*").alias("items")))


_RUNS = """runs AS (SELECT o_orderkey AS run_id, o_orderdate + INTERVAL (o_orderkey % 1440) MINUTE AS ts, CASE o_orderkey % 4 WHEN 0 THEN 'scrape' WHEN 1 THEN 'crawl' WHEN 2 THEN 'watch' ELSE 'research' END AS command,
  CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'F' THEN 'finished' ELSE 'forgotten' END AS status, o_orderkey % 9 AS pages_ok, o_orderkey % 2 AS pages_err, o_custkey AS prompt_tokens, o_custkey // 7 AS completion_tokens, o_totalprice / 1000 AS usd, o_custkey % 4 AS provider_no FROM orders)"""


def _runs(spark, sf_dir):
    k = F.col("o_orderkey")
    ts = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (k % 1440).cast("int"), F.lit(0))
    command = F.element_at(F.array(*map(F.lit, ("scrape", "crawl", "watch", "research"))), (k % 4 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "F", "finished").otherwise("forgotten")
    usd = (F.col("o_totalprice") / 1000).alias("usd")
    return table(spark, sf_dir, "orders").select(k.alias("run_id"), ts.alias("ts"), command.alias("command"), status.alias("status"), (k % 9).alias("pages_ok"), (k % 2).alias("pages_err"), F.col("o_custkey").alias("prompt_tokens"), F.floor(F.col("o_custkey") / 7).alias("completion_tokens"), usd, (F.col("o_custkey") % 4).alias("provider_no"))


@query(
    f"""WITH {_RUNS} SELECT CAST(ts + INTERVAL 420 MINUTE AS DATE) AS day, command, status, COUNT(*) AS runs, CAST(SUM(pages_ok) AS BIGINT) AS pages_ok, CAST(SUM(pages_err) AS BIGINT) AS pages_err, CAST(SUM(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(SUM(completion_tokens) AS BIGINT) AS completion_tokens, round(SUM(usd), 6) AS usd
    FROM runs WHERE command <> 'watch' AND ts >= TIMESTAMP '1997-01-01' GROUP BY 1, 2, 3"""
)
def activity_by_day(spark, sf_dir):
    return ledger.activity(_runs(spark, sf_dir), 420, since="1997-01-01")


@query(
    f"""WITH {_RUNS} SELECT provider_no, COUNT(*) AS calls, CAST(SUM(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(SUM(completion_tokens) AS BIGINT) AS completion_tokens, round(SUM(usd), 6) AS usd
    FROM runs WHERE ts >= TIMESTAMP '1997-01-01' GROUP BY 1"""
)
def spend_by_provider(spark, sf_dir):
    return ledger.spend_by(_runs(spark, sf_dir), "provider_no", since="1997-01-01")


@query(f"WITH {_RUNS} SELECT command, COUNT(*) FILTER (WHERE status = 'running') AS running, COUNT(*) FILTER (WHERE status = 'finished') AS finished, COUNT(*) FILTER (WHERE status = 'forgotten') AS forgotten FROM runs GROUP BY 1")
def crawl_stats(spark, sf_dir):
    return ledger.status_counts(_runs(spark, sf_dir), ("running", "finished", "forgotten"), by="command")


@query(
    """SELECT p_brand AS domain, COUNT(DISTINCT p_type) AS schemas, CAST(SUM(len(json_keys('{"a":1,"b":' || p_size || '}'))) AS BIGINT) AS fields, MAX(p_size) AS samples, MAX(p_partkey) AS updated FROM part GROUP BY 1"""
)
def selector_rollup(spark, sf_dir):
    json = F.concat(F.lit('{"a":1,"b":'), F.col("p_size").cast("string"), F.lit("}"))
    rows = table(spark, sf_dir, "part").withColumn("n", F.json_object_keys(json))
    return rows.groupBy(F.col("p_brand").alias("domain")).agg(F.count_distinct("p_type").alias("schemas"), F.sum(F.size("n")).alias("fields"), F.max("p_size").alias("samples"), F.max("p_partkey").alias("updated"))


@query(f"WITH {_RUNS} SELECT r.run_id, r.prompt_tokens AS own_tokens, COUNT(l.l_orderkey) AS calls, round(COALESCE(SUM(l.l_extendedprice), 0), 2) AS usd FROM runs r LEFT JOIN lineitem l ON l.l_orderkey = r.run_id GROUP BY 1, 2")
def run_rollup(spark, sf_dir):
    calls = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").alias("calls"), F.round(F.sum("l_extendedprice"), 2).alias("usd"))
    rows = _runs(spark, sf_dir).select("run_id", F.col("prompt_tokens").alias("own_tokens")).join(calls, "run_id", "left")
    return rows.select("run_id", "own_tokens", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("usd", F.lit(0.0)).alias("usd"))


@query(f"WITH {_RUNS} SELECT run_id, ts, command, status FROM runs WHERE command <> 'watch' AND status <> 'forgotten' ORDER BY ts DESC, run_id DESC LIMIT 25")
def list_runs(spark, sf_dir):
    rows = _runs(spark, sf_dir).where("command <> 'watch' AND status <> 'forgotten'")
    return rows.select("run_id", "ts", "command", "status").orderBy(F.desc("ts"), F.desc("run_id")).limit(25)


_VERSIONS = "versions AS (SELECT user_id AS url, event_id AS seq, CAST(floor(value) AS BIGINT) AS content, event_type AS source FROM events)"


def _versions(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("url"), F.col("event_id").alias("seq"), F.floor("value").alias("content"), F.col("event_type").alias("source"))


@query(f"WITH {_VERSIONS} SELECT url, MAX(seq) AS seq, arg_max(content, seq) AS content, arg_max(source, seq) AS source FROM versions WHERE source IN ('view', 'click') GROUP BY url")
def latest_snapshot(spark, sf_dir):
    return ledger.latest(_versions(spark, sf_dir).where("source IN ('view', 'click')"), "url", ["seq"])


@query(f"WITH {_VERSIONS} SELECT url, seq, COALESCE(lag(content) OVER (PARTITION BY url ORDER BY seq) <> content, FALSE) AS changed FROM versions")
def change_flag(spark, sf_dir):
    return ledger.change_flags(_versions(spark, sf_dir), "url", ["seq"], "content").select("url", "seq", "changed")


@query(f"WITH {_VERSIONS} SELECT v.url, v.seq, v.content FROM versions v JOIN (SELECT user_id AS url, event_id AS seq FROM events WHERE event_type = 'purchase') p ON p.url = v.url AND p.seq = v.seq")
def snapshot_at(spark, sf_dir):
    versions = _versions(spark, sf_dir).select("url", "seq", "content")
    pins = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("url"), F.col("event_id").alias("seq"))
    return versions.join(pins, ["url", "seq"])


@query(f"WITH {_VERSIONS}, r AS (SELECT url, seq, ROW_NUMBER() OVER (PARTITION BY url ORDER BY seq DESC) AS nth FROM versions) SELECT url, seq, CAST(nth AS INTEGER) AS nth FROM r WHERE nth <= 10")
def snapshot_topn(spark, sf_dir):
    return ledger.newest(_versions(spark, sf_dir), "url", ["seq"], 10).select("url", "seq", "nth")


_WINDOW = "OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"


@query(f"SELECT event_id, COUNT(*) {_WINDOW} AS seen, round(AVG(CASE WHEN value < 5 THEN 1.0 ELSE 0.0 END) {_WINDOW}, 9) AS null_rate, COUNT(*) {_WINDOW} >= 10 AND AVG(CASE WHEN value < 5 THEN 1.0 ELSE 0.0 END) {_WINDOW} > 0.3 AS trigger FROM events")
def null_rate_window(spark, sf_dir):
    rows = ledger.null_rates(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"], F.col("value") < 5)
    return rows.select("event_id", "seen", F.round("null_rate", 9).alias("null_rate"), "trigger")


@query(
    """WITH l AS (SELECT user_id, list({'ring': []::INTEGER[], 'fired': 0, 'v': CAST(value < 8 AS INTEGER)} ORDER BY event_id) AS l FROM events GROUP BY user_id),
    f AS (SELECT user_id, len(l) AS n, list_reduce(list_prepend({'ring': []::INTEGER[], 'fired': 0, 'v': 0}, l), lambda a, x: {
      'ring': CASE WHEN len(list_append(a.ring, x.v)[-50:]) >= 10 AND list_avg(list_append(a.ring, x.v)[-50:]) > 0.3 THEN []::INTEGER[] ELSE list_append(a.ring, x.v)[-50:] END,
      'fired': a.fired + CASE WHEN len(list_append(a.ring, x.v)[-50:]) >= 10 AND list_avg(list_append(a.ring, x.v)[-50:]) > 0.3 THEN 1 ELSE 0 END, 'v': x.v}) AS s FROM l)
    SELECT user_id, CAST(n AS INTEGER) AS outcomes, s.fired AS triggers, CAST(len(s.ring) AS INTEGER) AS in_ring FROM f"""
)
def null_rate_reset(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("is_null", F.col("value") < 8)
    return ledger.null_rate_resets(rows, ["user_id"], "event_id", "is_null")


@query("WITH r AS (SELECT event_type AS domain, event_id, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS nth FROM events WHERE value > 10) SELECT domain, event_id, CAST(nth AS INTEGER) AS nth FROM r WHERE nth <= 3")
def sample_ring(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value > 10").select(F.col("event_type").alias("domain"), "event_id")
    return ledger.newest(rows, "domain", ["event_id"], 3)


@query(
    """WITH g AS (SELECT *, SUM(CASE WHEN value > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
    s AS (SELECT event_id, user_id, SUM(CASE WHEN value > 20 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY event_id) AS streak FROM g)
    SELECT event_id, CAST(streak AS BIGINT) AS streak, streak >= 3 AS stale FROM s"""
)
def stale_streak(spark, sf_dir):
    rows = ledger.streaks(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.col("value") > 20)
    return rows.select("event_id", F.col("streak").cast("long").alias("streak"), (F.col("streak") >= 3).alias("stale"))


_FOLD_STATUS = {"view": 200, "click": 204, "signup": 404, "purchase": 429, "error": 503}


@query(
    f"""WITH r AS (SELECT user_id, event_id, {{"delay": 1.0::DOUBLE, "status": CASE event_type {" ".join(f"WHEN '{k}' THEN {c}" for k, c in _FOLD_STATUS.items())} ELSE 0 END, "asked": CASE WHEN event_id % 50 = 0 THEN 7 END}} AS x FROM events),
    l AS (SELECT user_id, list(x ORDER BY event_id) AS l FROM r GROUP BY user_id)
    SELECT user_id, list_reduce(list_prepend({{"delay": 1.0::DOUBLE, "status": 0, "asked": NULL::INTEGER}}, l), lambda a, x: {{
      "delay": CASE WHEN x.status = 429 OR x.status BETWEEN 500 AND 599 THEN CASE WHEN x.asked IS NULL THEN least(60.0, a.delay * 2) ELSE least(300.0, greatest(a.delay, CAST(x.asked AS DOUBLE))) END
        WHEN x.status BETWEEN 200 AND 299 THEN greatest(1.0, a.delay * 0.75) ELSE a.delay END, "status": x.status, "asked": x.asked}}).delay AS delay FROM l"""
)
def throttle_fold(spark, sf_dir):
    status = F.lit(0)
    for kind, code in _FOLD_STATUS.items():
        status = F.when(F.col("event_type") == kind, code).otherwise(status)
    reports = table(spark, sf_dir, "events").select("user_id", "event_id", status.alias("status"), F.when(F.col("event_id") % 50 == 0, 7).alias("retry_after"))
    return ledger.throttle(reports, "user_id", "event_id")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'ok' WHEN 'signup' THEN 'permanent' ELSE 'retry' END AS class FROM events")
def retry_taxonomy(spark, sf_dir):
    status = F.element_at(F.create_map(*(F.lit(x) for kv in _FOLD_STATUS.items() for x in kv)), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", classify.retry_class(status).alias("class"))


_LISTS = "lists AS (SELECT user_id AS list_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, 'http://ex.com/' || CAST(floor(value) AS BIGINT) AS url FROM events)"


def _lists(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    url = F.concat(F.lit("http://ex.com/"), F.floor("value").cast("string"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("list_id"), n.alias("rank"), url.alias("url"))


@query(
    f"""WITH {_LISTS}, f AS (SELECT list_id, url, MIN(rank) AS rank FROM lists GROUP BY 1, 2)
    SELECT url, round(SUM(1.0::DOUBLE / (60 + rank)) * CASE WHEN ends_with(url, '7') THEN 2.0 ELSE 1.0 END * CASE WHEN ends_with(url, '3') THEN 0.5 ELSE 1.0 END, 6) AS score, COUNT(*) AS lists, CAST(MIN(rank) AS INTEGER) AS best_rank FROM f GROUP BY url"""
)
def rrf_rank(spark, sf_dir):
    fused = rank.fuse(_lists(spark, sf_dir), preferred=F.col("url").endswith("7"), low_value=F.col("url").endswith("3"))
    return rank.order(fused).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_LISTS}, v AS (SELECT DISTINCT 'http://ex.com/' || (o_custkey % 13) AS url FROM orders), h AS (SELECT list_id, url, MIN(rank) AS rank FROM lists WHERE url NOT IN (SELECT url FROM v) GROUP BY 1, 2),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY list_id ORDER BY rank, url) AS pick FROM h) SELECT list_id, url, CAST(rank AS INTEGER) AS rank, CAST(pick AS INTEGER) AS pick FROM r WHERE pick <= 3"""
)
def topk_unvisited(spark, sf_dir):
    visited = table(spark, sf_dir, "orders").select(F.concat(F.lit("http://ex.com/"), (F.col("o_custkey") % 13).cast("string")).alias("url")).distinct()
    hits = _lists(spark, sf_dir).groupBy("list_id", "url").agg(F.min("rank").alias("rank"))
    return rank.pick(hits, visited, ["list_id"], 3).select("list_id", "url", "rank", "pick")


_KEY = r"array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(lower({}), '\s+'), lambda t: regexp_replace(t, '^[^\p{{L}}\p{{N}}+#]+|[^\p{{L}}\p{{N}}+#]+$', '', 'g')), lambda t: t <> '')), ' ')"


@query(
    rf"""WITH q AS (SELECT conv_id, turn, role, {_KEY.format("regexp_extract(text, '^[^.!?]*')")} AS query_key FROM conversations),
    d AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_key ORDER BY conv_id, turn) AS n FROM q WHERE query_key <> '' AND role = 'user')
    SELECT conv_id, turn, query_key FROM d WHERE n = 1 AND query_key NOT IN (SELECT query_key FROM q WHERE role = 'system')"""
)
def query_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.regexp_extract("text", "^[^.!?]*", 0).alias("q"))
    fresh = rank.dedupe_queries(rows.where("role = 'user'").withColumn("all", F.lit(0)), rows.where("role = 'system'").withColumn("all", F.lit(0)), "q", ["all"], ["conv_id", "turn"])
    return fresh.select("conv_id", "turn", "query_key")


@query("SELECT l_orderkey, 'f' || ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS fact_id, l_suppkey AS run_id FROM lineitem")
def fact_ids(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "run_id")
    return ledger.mint_ids(facts, "run_id", ["l_orderkey", "l_linenumber", "l_partkey"]).select("l_orderkey", "fact_id", "run_id")


_QUOTE = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"


@query(
    f"""WITH snapshots AS (SELECT doc_id % 50 AS url_hash, doc_id AS checked_at, length(text) AS n FROM documents), facts AS (SELECT item_id AS run_id, item_id % 50 AS url_hash, item_id AS checked_at, 'f' || item_id AS fact_id FROM benchmark)
    SELECT f.fact_id, f.run_id, s.n FROM facts f JOIN snapshots s USING (url_hash, checked_at)"""
)
def facts_with_snapshots(spark, sf_dir):
    snapshots = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("url_hash"), F.col("doc_id").alias("checked_at"), F.length("text").cast("long").alias("n"))
    facts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("run_id"), (F.col("item_id") % 50).alias("url_hash"), F.col("item_id").alias("checked_at"), F.concat(F.lit("f"), F.col("item_id").cast("string")).alias("fact_id"))
    return facts.join(snapshots, ["url_hash", "checked_at"]).select("fact_id", "run_id", "n")


_FORGET = """snapshots AS (SELECT DISTINCT l_partkey AS url_hash, l_linenumber AS checked_at FROM lineitem), links AS (SELECT DISTINCT l_suppkey AS run_id, l_partkey AS url_hash, l_linenumber AS checked_at FROM lineitem),
facts AS (SELECT DISTINCT l_suppkey AS run_id, l_partkey AS url_hash, l_linenumber AS checked_at FROM lineitem WHERE l_quantity > 40)"""


@query(
    f"""WITH {_FORGET}, own AS (SELECT url_hash, checked_at FROM links WHERE run_id = 3), other AS (SELECT url_hash, checked_at FROM links WHERE run_id <> 3 UNION SELECT url_hash, checked_at FROM facts WHERE run_id <> 3)
    SELECT s.url_hash, s.checked_at FROM snapshots s WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.url_hash = s.url_hash AND o.checked_at = s.checked_at AND NOT EXISTS (SELECT 1 FROM other t WHERE t.url_hash = o.url_hash AND t.checked_at = o.checked_at))"""
)
def forget_run(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.col("l_partkey").alias("url_hash"), F.col("l_linenumber").alias("checked_at"), "l_quantity")
    links = rows.select("run_id", "url_hash", "checked_at").distinct()
    return ledger.forget_run(rows.select("url_hash", "checked_at").distinct(), links, rows.where("l_quantity > 40").select("run_id", "url_hash", "checked_at").distinct(), 3)


@query(
    "SELECT url_hash, 'inflight' AS status FROM (SELECT o_orderkey AS url_hash, o_orderdate AS discovered_at FROM orders WHERE o_orderstatus = 'P' ORDER BY discovered_at, url_hash LIMIT 32)"
)
def claim_pending(spark, sf_dir):
    state = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("url_hash"), F.col("o_orderdate").alias("discovered_at"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"))
    return ledger.claim(state, 32).select("url_hash", "status")


@query(
    f"""WITH q AS (SELECT item_id, {_QUOTE.format("text")} AS q FROM benchmark), d AS (SELECT doc_id, {_QUOTE.format("text")} AS t FROM documents)
    SELECT q.item_id, d.doc_id FROM q JOIN d ON contains(d.t, q.q) WHERE length(q.q) BETWEEN 20 AND 600"""
)
def quote_verify(spark, sf_dir):
    """Which documents hold a benchmark passage of 20 to 600 characters, whole."""
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    quotes = table(spark, sf_dir, "benchmark").select("item_id", fold(F.col("text")).alias("q")).where(F.length("q").between(20, 600))
    pages = table(spark, sf_dir, "documents").select("doc_id", fold(F.col("text")).alias("t"))
    return evidence.containing(pages, "t", quotes, "q").select("item_id", "doc_id")


_FACTS = """facts AS (SELECT o_custkey AS run_id, 'f' || o_orderkey AS fact_id, 'd' || (o_orderkey % 5) AS domain, CASE WHEN o_orderkey % 4 = 0 THEN 'softened' ELSE 'unverified' END AS status, o_orderpriority AS claim, 'old' AS note FROM orders),
evidence AS (SELECT o.o_custkey AS run_id, 'f' || o.o_orderkey AS fact_id, CASE WHEN l.l_linenumber = 4 THEN NULL ELSE 'f' || l.l_partkey END AS other_id, 'd' || (l.l_partkey % 5) AS domain,
  CASE WHEN l.l_quantity > 45 THEN 'contradicts' ELSE 'supports' END AS stance, l.l_partkey AS n FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey)"""


def _facts(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    fact = F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("fact_id")
    facts = orders.select(
        F.col("o_custkey").alias("run_id"), fact, F.concat(F.lit("d"), (F.col("o_orderkey") % 5).cast("string")).alias("domain"),
        F.when(F.col("o_orderkey") % 4 == 0, "softened").otherwise("unverified").alias("status"), F.col("o_orderpriority").alias("claim"), F.lit("old").alias("note"),
    )
    joined = orders.join(items, F.col("l_orderkey") == F.col("o_orderkey"))
    found = joined.select(
        F.col("o_custkey").alias("run_id"), fact, F.when(F.col("l_linenumber") != 4, F.concat(F.lit("f"), F.col("l_partkey").cast("string"))).alias("other_id"),
        F.concat(F.lit("d"), (F.col("l_partkey") % 5).cast("string")).alias("domain"), F.when(F.col("l_quantity") > 45, "contradicts").otherwise("supports").alias("stance"),
    )
    return facts, found


_SETTLED = f"""{_FACTS}, j AS (SELECT f.run_id, f.fact_id, f.domain, f.status, f.note, f.claim, COALESCE(bool_or(e.stance = 'contradicts'), FALSE) AS bad,
  MIN(CASE WHEN e.stance = 'supports' AND e.domain <> f.domain THEN e.n END) AS w FROM facts f LEFT JOIN evidence e ON e.run_id = f.run_id AND e.fact_id = f.fact_id AND e.other_id IS NOT NULL GROUP BY ALL),
settled AS (SELECT run_id, fact_id, domain, CASE WHEN bad THEN 'contested' WHEN w IS NOT NULL AND status <> 'softened' THEN 'verified' ELSE 'softened' END AS status,
  CASE WHEN bad THEN note WHEN w IS NOT NULL AND status = 'softened' THEN note WHEN w IS NOT NULL THEN 'corroborated by f' || w || ' (d' || (w % 5) || ')' ELSE 'Per ' || domain || ': ' || claim END AS note FROM j)"""


@query(f"WITH {_SETTLED} SELECT * FROM settled")
def settle_facts(spark, sf_dir):
    return evidence.settle(*_facts(spark, sf_dir))


@query(
    f"""WITH {_SETTLED}, r AS (SELECT run_id, fact_id, status, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY CASE status WHEN 'verified' THEN 0 WHEN 'softened' THEN 1 ELSE 2 END, CAST(substr(fact_id, 2) AS BIGINT)) AS nth FROM settled)
    SELECT run_id, fact_id, status, CAST(nth AS INTEGER) AS nth FROM r WHERE nth <= 5"""
)
def writer_order(spark, sf_dir):
    return evidence.writer_order(evidence.settle(*_facts(spark, sf_dir)), 5).select("run_id", "fact_id", "status", "nth")


@query(
    """WITH v AS (SELECT user_id AS url, event_id, CAST(floor(value / 10) AS BIGINT) AS h FROM events), a AS (SELECT url, arg_max(h, event_id) AS h FROM v WHERE event_id % 3 = 0 AND url % 7 <> 0 GROUP BY url),
    b AS (SELECT url, arg_max(h, event_id) AS h FROM v WHERE event_id % 3 <> 0 AND url % 5 <> 0 GROUP BY url)
    SELECT COALESCE(a.url, b.url) AS url, CASE WHEN a.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'gone' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.url = b.url WHERE a.url IS NULL OR b.url IS NULL OR a.h <> b.h"""
)
def evidence_diff(spark, sf_dir):
    pins = table(spark, sf_dir, "events").select(F.col("user_id").alias("url"), F.floor(F.col("value") / 10).alias("content_hash"), F.col("event_id").alias("checked_at"))
    return evidence.evidence_diff(pins.where("checked_at % 3 = 0 AND url % 7 <> 0"), pins.where("checked_at % 3 <> 0 AND url % 5 <> 0"))


@query(
    """SELECT doc_id, round(CASE doc_id % 4 WHEN 0 THEN n / 1e6 * 0.15 + 0.0006 WHEN 1 THEN n / 1e6 * 1.0 + 0.005 WHEN 2 THEN 0.0 ELSE n / 1e6 * 2.0 + 0.01 END, 9) AS usd FROM (SELECT doc_id, strlen(text) // 4 AS n FROM documents)"""
)
def cost_projection(spark, sf_dir):
    model = F.element_at(F.array(*map(F.lit, ("gpt-4o-mini", "claude-haiku-4-5", "some:free", "unknown"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", model.alias("model"), F.floor(F.octet_length("text") / 4).alias("n"))
    return rows.select("doc_id", F.round(classify.cost(F.col("model"), F.col("n"), F.lit(1000), fallback=True), 9).alias("usd"))


@query(
    """WITH c AS (SELECT o_orderkey, o_custkey, o_totalprice AS usd, COALESCE(round(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6), 0) AS running FROM orders)
    SELECT o_orderkey, round(running, 2) AS running, running + usd <= 1000000 AS admitted FROM c"""
)
def cost_ceiling(spark, sf_dir):
    calls = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("usd"))
    rows = ledger.within_ceiling(calls, ["o_custkey"], ["o_orderkey"], "usd", 1_000_000)
    return rows.select("o_orderkey", F.round("running", 2).alias("running"), "admitted")
