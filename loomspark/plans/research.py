"""Queries over research runs, host decisions and single values, each with inputs made of the tables' own columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, coerce, hosting
from ..functions import text as texts
from ..operators import evidence, lines, research
from ..sources import web
from ..sources.tables import table
from .registry import query

_ONE_LINE = r"trim(regexp_replace(COALESCE({}, ''), '\s+', ' ', 'g'))"


@query(
    rf"""WITH a AS (SELECT conv_id AS run_id, turn, {_ONE_LINE.format("CASE WHEN turn % 4 = 3 THEN '  ' ELSE text END")} AS question,
      list_filter([{_ONE_LINE.format("CASE WHEN turn % 2 = 0 THEN role || chr(10) || ' ' || turn END")}, {_ONE_LINE.format("CASE WHEN turn % 3 = 0 THEN left(text, 40) END")}], lambda q: q <> '') AS queries FROM conversations),
    n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY turn, question) AS position FROM a WHERE question <> '')
    SELECT run_id, CAST(position AS INTEGER) AS position, md5(question) AS question, CASE WHEN len(queries) = 0 THEN [question] ELSE queries END AS queries FROM n WHERE position <= 3"""
)
def plan_tidy(spark, sf_dir):
    turn = F.col("turn")
    asked = F.array(F.when(turn % 2 == 0, F.concat("role", F.lit("\n "), turn.cast("string"))), F.when(turn % 3 == 0, F.left("text", F.lit(40))))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), turn.alias("position"), F.when(turn % 4 == 3, "  ").otherwise(F.col("text")).alias("question"), asked.alias("queries"))
    return research.tidy_plan(rows, 3).withColumn("question", F.md5("question"))


@query(
    """WITH m AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN ' ' || props || ' ' WHEN 'view' THEN '  ' END AS steer, event_type = 'error' AS stop FROM events)
    SELECT event_id, COALESCE(last_value(CASE WHEN trim(steer) <> '' THEN trim(steer) END IGNORE NULLS) OVER w, '') AS steer, bool_or(stop) OVER w AS write_now
    FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def steering_fold(spark, sf_dir):
    kind = F.col("event_type")
    steer = F.when(kind == "purchase", F.concat(F.lit(" "), "props", F.lit(" "))).when(kind == "view", F.lit("  "))
    messages = table(spark, sf_dir, "events").select("user_id", "event_id", steer.alias("steer"), (kind == "error").alias("write_now"))
    return research.control(messages, "user_id", ["event_id"]).select("event_id", "steer", "write_now")


@query(
    """WITH f AS (SELECT o_orderkey AS n, 'u' || (o_custkey % 50) AS url, lower('of ' || o_orderpriority || ' for ' || (o_orderkey % 31)) AS q FROM orders),
    a AS (SELECT url, q, MIN(n) AS old_id FROM f WHERE n % 3 <> 0 GROUP BY ALL), b AS (SELECT url, q, MIN(n) AS new_id FROM f WHERE n % 5 <> 0 GROUP BY ALL)
    SELECT COALESCE(a.url, b.url) AS url, old_id, new_id FROM a FULL JOIN b ON a.url = b.url AND a.q = b.q"""
)
def fact_match(spark, sf_dir):
    """Two runs that quote the same passages, one in capitals and with other spaces."""
    number, priority = (F.col("o_orderkey") % 31).cast("string"), F.col("o_orderpriority")
    quote = F.concat(F.lit("of "), priority, F.lit(" for "), number)
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact_id"), F.concat(F.lit("u"), (F.col("o_custkey") % 50).cast("string")).alias("url"), quote.alias("quote"))
    after = facts.where("fact_id % 5 <> 0").withColumn("quote", F.upper(F.regexp_replace("quote", " ", "  ")))
    return evidence.match_facts(facts.where("fact_id % 3 <> 0"), after)


@query()
def budget_governor(spark, sf_dir):
    """Orders as model calls of their customers' runs: asked for, then logged at their true cost by the next odd number."""
    orders = table(spark, sf_dir, "orders")
    k, usd = F.col("o_orderkey"), F.col("o_totalprice") / 1000
    kind = F.when(k % 10 == 0, "write").when(k % 10 == 1, "finish").otherwise("research")
    ask = orders.select(F.col("o_custkey").alias("run_id"), (2 * k).alias("seq"), F.lit("ask").alias("event"), k.cast("string").alias("call"), kind.alias("kind"), usd.alias("usd"), (k % 7 == 0).alias("flat"))
    log = orders.select(F.col("o_custkey").alias("run_id"), (2 * k + 61).alias("seq"), F.lit("logged").alias("event"), k.cast("string").alias("call"), kind.alias("kind"), (usd / 2).alias("usd"), F.lit(False).alias("flat"))
    return research.govern(ask.unionByName(log), 500.0)


_PROVIDERS = ("openai", "codex", "Ollama", "openrouter", "", None)
_MODELS = ("gpt-4o-mini", "llama3.1", "ollama/phi", "any:FREE", "mystery")


@query(
    """WITH c AS (SELECT p_partkey, p_size * 1000.0::DOUBLE AS n, CAST(p_partkey AS DOUBLE) AS m, ['openai', 'codex', 'Ollama', 'openrouter', '', NULL][CAST(p_size % 6 AS INTEGER) + 1] AS provider,
      ['gpt-4o-mini', 'llama3.1', 'ollama/phi', 'any:FREE', 'mystery'][CAST(p_partkey % 5 AS INTEGER) + 1] AS model FROM part)
    SELECT p_partkey, round(CASE WHEN provider IN ('codex', 'Ollama', '') THEN 0.0 WHEN provider IS NULL AND model IN ('llama3.1', 'ollama/phi', 'any:FREE') THEN 0.0
      WHEN model = 'gpt-4o-mini' THEN n / 1e6 * 0.15 + m / 1e6 * 0.60 WHEN model = 'any:FREE' THEN 0.0 WHEN provider IS NULL THEN 0.0 ELSE n / 1e6 * 2.0 + m / 1e6 * 10.0 END, 9) AS usd FROM c"""
)
def provider_costs(spark, sf_dir):
    """A name that is free elsewhere is metered where its provider is."""
    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))
    usd = classify.cost(pick(_MODELS, "p_partkey"), F.col("p_size") * 1000.0, F.col("p_partkey").cast("double"), provider=pick(_PROVIDERS, "p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(usd, 9).alias("usd"))


_MODEL = "CASE p_size % 4 WHEN 0 THEN 'Ollama/' || p_name WHEN 1 THEN p_name || ':FREE' WHEN 2 THEN 'llama' || p_brand ELSE p_type END"


@query(
    f"""SELECT p_partkey, lower({_MODEL}) LIKE 'ollama/%' OR lower({_MODEL}) LIKE 'llama%' OR lower({_MODEL}) LIKE '%:free' AS free, left(repeat(p_name || ' ', 60), 1000) AS message,
    CASE WHEN p_size % 6 = 0 THEN FALSE WHEN lower(p_brand) IN ('codex', 'ollama') THEN FALSE ELSE TRUE END AS keyed FROM part"""
)
def provider_rules(spark, sf_dir):
    size = F.col("p_size")
    model = F.when(size % 4 == 0, F.concat(F.lit("Ollama/"), "p_name")).when(size % 4 == 1, F.concat("p_name", F.lit(":FREE"))).when(size % 4 == 2, F.concat(F.lit("llama"), "p_brand")).otherwise(F.col("p_type"))
    provider = F.when(size % 6 == 0, "").otherwise(F.col("p_brand"))
    message = hosting.error_message(F.repeat(F.concat("p_name", F.lit(" ")), 60))
    return table(spark, sf_dir, "part").select("p_partkey", hosting.is_free_model(model).alias("free"), message.alias("message"), hosting.needs_key(provider).alias("keyed"))


@query(
    """SELECT o_orderkey, CASE WHEN a >= 4 OR s IN (200, 404) THEN NULL WHEN s IN (429, 503) AND o_custkey % 2 = 0 THEN CAST(o_custkey % 90 AS DOUBLE) ELSE -least(30.0, 0.5 * pow(2, a - 1)) END AS wait
    FROM (SELECT *, 1 + o_orderkey % 5 AS a, [500, 429, 503, 404, 200, 502][CAST(o_custkey % 6 AS INTEGER) + 1] AS s FROM orders)"""
)
def retry_waits(spark, sf_dir):
    """Waits before the next try: those that were asked for, and, as their negatives, the middles that hashed jitter stays within a half of."""
    attempt, status = 1 + F.col("o_orderkey") % 5, F.element_at(F.array(*map(F.lit, (500, 429, 503, 404, 200, 502))), (F.col("o_custkey") % 6 + 1).cast("int"))
    asked = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 90)
    wait = hosting.retry_wait(attempt, status, asked, F.col("o_orderkey"))
    middle = F.least(F.lit(30.0), 0.5 * F.pow(F.lit(2.0), attempt - 1))
    jittered = wait.isNotNull() & ~(status.isin(429, 503) & asked.isNotNull()) & (wait >= middle / 2) & (wait <= middle * 1.5)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(jittered, -middle).otherwise(wait).alias("wait"))


@query(
    r"""SELECT doc_id, NULLIF(regexp_extract(text, '[Tt]h(\w+)', 1), '') AS grouped, NULLIF(regexp_extract(text, '\d{4,}', 0), '') AS whole,
    TRY_CAST(regexp_replace(regexp_extract(replace(text, ',', ''), '(\d[\d.]*)', 1), '\.+$', '') AS DOUBLE) AS number FROM documents"""
)
def regex_fields(spark, sf_dir):
    t = F.col("text")
    found = {"grouped": coerce.by_regex(t, r"[Tt]h(\w+)"), "whole": coerce.by_regex(t, r"\d{4,}"), "number": coerce.first_number(t)}
    return table(spark, sf_dir, "documents").select("doc_id", *(F.nullif(c, F.lit("")).alias(n) if n != "number" else c.alias(n) for n, c in found.items()))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE CAST(p_size + 0.5::DOUBLE AS VARCHAR) END AS n FROM part")
def canonical_numbers(spark, sf_dir):
    """Whole numbers as they are, others written with zeros at their ends."""
    written = F.when(F.col("p_size") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".500")))
    return table(spark, sf_dir, "part").select("p_partkey", coerce.canonical_number(written).alias("n"))


@query(
    r"""SELECT p_partkey, [p_name, CASE WHEN regexp_full_match(p_type, '\s*[A-Za-z][\w\s&/-]{1,40}\s*') THEN p_type || ': ' || p_size ELSE CAST(p_size AS VARCHAR) END]
      || CASE WHEN regexp_full_match(p_type, '\s*[A-Za-z][\w\s&/-]{1,40}\s*') THEN [] ELSE [p_type] END || ['7%', '12'] AS lines FROM part"""
)
def stat_lines(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", lines.merge_stats(F.array("p_name", F.col("p_size").cast("string"), "p_type", F.lit("7%"), F.lit("12"))).alias("lines"))


@query(r"""SELECT p_partkey, regexp_matches(t, '^[$€£]?-?[0-9][0-9,.]*%?$') AS numeric FROM (SELECT p_partkey, ['$', '', '-', 'x'][CAST(p_size % 4 AS INTEGER) + 1] || p_retailprice || ['%', '', ' kg'][CAST(p_size % 3 AS INTEGER) + 1] AS t FROM part)""")
def numeric_texts(spark, sf_dir):
    front = F.element_at(F.array(*map(F.lit, ("$", "", "-", "x"))), (F.col("p_size") % 4 + 1).cast("int"))
    back = F.element_at(F.array(*map(F.lit, ("%", "", " kg"))), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", texts.is_numeric_text(F.concat(front, F.col("p_retailprice").cast("string"), back)).alias("numeric"))


@query("""SELECT n_name AS host, unnest(CASE n_nationkey % 3 WHEN 0 THEN ['https://' || lower(n_name) || '/s1.xml', 'https://' || lower(n_name) || '/s2.xml'] ELSE ['https://' || lower(n_name) || '/sitemap.xml'] END) AS url FROM nation""")
def sitemaps_of_hosts(spark, sf_dir):
    """Hosts whose robots files name sitemaps, name none, or are not there."""
    site = F.concat(F.lit("https://"), F.lower("n_name"))
    named = F.concat(F.lit("User-agent: *\nSITEMAP : "), site, F.lit("/s1.xml # first\nsitemap:"), site, F.lit("/s2.xml\n"))
    body = F.when(F.col("n_nationkey") % 3 == 0, named).when(F.col("n_nationkey") % 3 == 1, "Disallow: /")
    return web.sitemaps_of(table(spark, sf_dir, "nation").select(F.col("n_name").alias("host"), site.alias("site"), body.alias("body")))
