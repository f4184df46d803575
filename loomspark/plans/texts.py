"""Queries over texts and typed fields: markdown, lines, caps, coercions, JSON, csv cells, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce, jsonfns, text
from ..operators import lines
from ..session import spread
from ..sources.tables import table
from .registry import query

# Documents as markdown: a heading, an image, links, a fence and a quote around the text.
_MD = r"""md AS (SELECT doc_id, '# Doc ' || doc_id || chr(10) || '![alt](http://x/i.png) **bold** and [link ' || doc_id || '](http://ex.com/' || (doc_id % 7) || ' "t") [](http://ex.com/bare) [in](#a)' || chr(10)
  || '```' || chr(10) || '> quoted *it* `code`' || chr(10) || chr(10) || chr(10) || chr(10) || text AS md FROM documents)"""


def _markdown(documents):
    n = F.col("doc_id").cast("string")
    lead = F.concat(F.lit("# Doc "), n, F.lit("\n![alt](http://x/i.png) **bold** and [link "), n, F.lit("](http://ex.com/"), (F.col("doc_id") % 7).cast("string"), F.lit(' "t") [](http://ex.com/bare) [in](#a)\n```\n> quoted *it* `code`\n\n\n\n'))
    return spread(documents.select("doc_id", "text")).select("doc_id", F.concat(lead, F.col("text")).alias("md"))


@query(
    rf"""WITH {_MD}, p AS (SELECT doc_id, regexp_replace(regexp_replace(md, '!\[([^\]]*)\]\(([^)]+)\)', '', 'g'), '\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)', '\1', 'g') AS t FROM md)
    SELECT doc_id, CAST(list_sum(list_transform(list_filter(string_split(t, chr(10)), lambda l: NOT starts_with(ltrim(l), '```')),
      lambda l: len(list_filter(regexp_split_to_array(regexp_replace(l, '[#*_`>~|()!\[\]-]+', ' ', 'g'), '\s+'), lambda w: w <> '')))) AS INTEGER) AS words FROM p"""
)
def md_word_count(spark, sf_dir):
    return _markdown(table(spark, sf_dir, "documents")).select("doc_id", text.markdown_words(F.col("md")).alias("words"))


_STEPS = [
    (r"`{3}[^`]*`{3}", ""), (r"!\[([^\]]*)\]\(([^)]+)\)", r"\1"), (r'\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)', r"\1"), (r"\*\*([^*]+)\*\*", r"\1"),
    (r"(^|[\s(])\*([^*\n]+)\*([\s).,;:!?]|$)", r"\1\2\3"), (r"`([^`\n]+)`", r"\1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^[ \t]*>[ \t]?", ""), (r"[ \t]+", " "), (r"(?m)^[ \t]+", ""), (r"\n{3,}", "\\n\\n"),
]


def _nested(sql: str) -> str:
    for pattern, new in _STEPS:
        to = "chr(10) || chr(10)" if new == "\\n\\n" else f"'{new}'"
        sql = f"regexp_replace({sql}, '{pattern}', {to}, 'g')"
    return sql


@query(rf"WITH {_MD} SELECT doc_id, sha256(regexp_replace({_nested('md')}, '^\s+|\s+\z', '', 'g')) AS plain_hash FROM md")
def md_to_text(spark, sf_dir):
    return _markdown(table(spark, sf_dir, "documents")).select("doc_id", F.sha2(text.plain_text(F.col("md")), 256).alias("plain_hash"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed FROM documents")
def ws_collapse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.collapse(F.col("text"))).alias("collapsed"))


@query(
    r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, md5(CASE WHEN len(w) > 50 THEN array_to_string(w[1:50], ' ') ELSE text END) AS capped FROM w"""
)
def cap_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.cap_words(F.col("text"), 50)).alias("capped"))


@query(
    r"""WITH s AS (SELECT doc_id, text, regexp_extract(text, '^((?:[^.!?]*[.!?]){3})', 1) AS x FROM documents)
    SELECT doc_id, md5(trim(CASE WHEN x <> '' THEN x ELSE text END)) AS capped FROM s"""
)
def cap_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.cap_sentences(F.col("text"), 3)).alias("capped"))


@query(
    rf"""WITH {_MD}, m AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(md, '!\[([^\]]*)\]\(([^)]+)\)', '', 'g'), '\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)')) AS m FROM md),
    p AS (SELECT doc_id, regexp_extract(m, '^\[([^\]]*)\]', 1) AS t, regexp_extract(m, '\]\(([^)\s]+)', 1) AS url FROM m)
    SELECT DISTINCT doc_id, CASE WHEN trim(t) = '' THEN url ELSE t END AS link_text, url FROM p WHERE NOT starts_with(url, '#')"""
)
def md_links(spark, sf_dir):
    rows = _markdown(table(spark, sf_dir, "documents")).select("doc_id", F.explode(text.markdown_links(F.col("md"))).alias("l"))
    return rows.select("doc_id", F.col("l.text").alias("link_text"), F.col("l.url").alias("url"))


@query("SELECT doc_id, CAST(strlen(text) // 4 AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


_LINES = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"""


@query(
    f"""WITH {_LINES}, r AS (SELECT *, trim(line) AS t, ROW_NUMBER() OVER (PARTITION BY doc_id, trim(line) ORDER BY pos) AS n FROM lines)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM r WHERE t <> '' AND (n = 1 OR regexp_matches(t, '^([|]|- |>)'))"""
)
def line_dedupe(spark, sf_dir):
    return lines.dedupe(lines.split(table(spark, sf_dir, "documents")))


@query(
    rf"""WITH {_LINES}, s AS (SELECT *, trim(line) <> '' AND strlen(trim(line)) < 40 AND NOT regexp_matches(trim(line), '[.!?|:]') AND NOT regexp_matches(trim(line), '^(#|[|]|- |>)') AS short FROM lines),
    i AS (SELECT *, pos - ROW_NUMBER() OVER (PARTITION BY doc_id, short ORDER BY pos) AS island FROM s),
    c AS (SELECT *, COUNT(*) OVER (PARTITION BY doc_id, short, island) AS n FROM i)
    SELECT doc_id, CAST(COUNT(*) FILTER (WHERE short AND n >= 2) AS BIGINT) AS dropped, CAST(COUNT(*) FILTER (WHERE NOT (short AND n >= 2)) AS BIGINT) AS kept FROM c GROUP BY doc_id"""
)
def short_line_runs(spark, sf_dir):
    marked = lines.mark_short_runs(lines.split(table(spark, sf_dir, "documents")))
    return marked.groupBy("doc_id").agg(F.count_if("in_run").alias("dropped"), F.count_if(~F.col("in_run")).alias("kept"))


@query("SELECT p_partkey, TRY_CAST(regexp_extract(p_brand, '#(.*)$', 1) AS BIGINT) AS brand_no, CAST(trunc(TRY_CAST(replace(CAST(p_size AS VARCHAR) || ',7', ',', '.') AS DOUBLE)) AS BIGINT) AS size_int, TRY_CAST(p_name AS BIGINT) AS name_int FROM part")
def coerce_int(spark, sf_dir):
    size = F.concat(F.col("p_size").cast("string"), F.lit(",7"))
    brand = F.regexp_extract("p_brand", "#(.*)$", 1)
    return table(spark, sf_dir, "part").select("p_partkey", coerce.to_int(brand).alias("brand_no"), coerce.to_int(size).alias("size_int"), coerce.to_int(F.col("p_name")).alias("name_int"))


@query("SELECT p_partkey, TRY_CAST(replace(replace(CAST(p_retailprice AS VARCHAR), '.', ','), ',', '.') AS DOUBLE) AS price, TRY_CAST(replace(p_name, ',', '.') AS DOUBLE) AS name_float FROM part")
def coerce_float(spark, sf_dir):
    price = F.replace(F.format_string("%s", F.col("p_retailprice")), F.lit("."), F.lit(","))
    return table(spark, sf_dir, "part").select("p_partkey", coerce.to_float(price).alias("price"), coerce.to_float(F.col("p_name")).alias("name_float"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) * 1000 + 0.5 AS eur FROM part")
def coerce_eur(spark, sf_dir):
    shown = F.concat(F.lit("€ "), F.col("p_size").cast("string"), F.lit(" 000,50 "))
    return table(spark, sf_dir, "part").select("p_partkey", coerce.to_eur(shown).alias("eur"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE WHEN 3 THEN FALSE END AS flag FROM orders")
def coerce_bool(spark, sf_dir):
    words = F.element_at(F.array(*map(F.lit, ("Ja", " nein ", "1", "NO", "maybe"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", coerce.to_bool(words).alias("flag"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def coerce_iso_date(spark, sf_dir):
    layouts = ("yyyy-MM-dd", "dd.MM.yyyy", "d.M.yyyy", "MMMM d, yyyy", "d MMM yyyy")
    forms = [F.date_format("o_orderdate", x) for x in layouts] + [F.concat(F.lit("on "), F.date_format("o_orderdate", "d.M.yyyy"), F.lit(" or so")), F.lit("soon")]
    shown = F.element_at(F.array(*forms), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", coerce.to_iso_date(shown).alias("iso"))


@query("SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS amount, ['USD', 'EUR', 'GBP'][CAST(p_partkey % 3 AS INTEGER) + 1] AS currency, CAST(p_size * 1000 AS BIGINT) AS likes FROM part")
def price_string(spark, sf_dir):
    sign = F.element_at(F.array(*map(F.lit, ("$", "€", "£"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    shown = F.concat(sign, F.lit(" "), F.format_string("%s", F.col("p_retailprice")), F.lit(" each"))
    likes = coerce.count_with_suffix(F.concat(F.col("p_size").cast("string"), F.lit("k likes")))
    return table(spark, sf_dir, "part").select("p_partkey", coerce.first_number(shown).alias("amount"), coerce.currency(shown).alias("currency"), likes.alias("likes"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string('{\"a\":[{\"b\":' || props || '}]}', '$.a[0].b.k') AS BIGINT) AS deep FROM events")
def json_path(spark, sf_dir):
    nested = F.concat(F.lit('{"a":[{"b":'), F.col("props"), F.lit("}]}"))
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", jsonfns.path(F.col("props"), "$.k", "long").alias("k"), jsonfns.path(nested, "$.a.0.b.k", "long").alias("deep"))


@query("SELECT event_id, unnest(['n', 'o.x', 'o.y', 's']) AS path, unnest([json_extract_string(props, '$.k'), CAST(user_id AS VARCHAR), event_type, event_type]) AS leaf FROM events")
def json_flatten(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    made = F.to_json(F.struct(jsonfns.path(F.col("props"), "$.k", "long").alias("n"), F.struct(F.col("user_id").alias("x"), F.col("event_type").alias("y")).alias("o"), F.col("event_type").alias("s")))
    return jsonfns.flatten(rows.select("event_id", made.alias("json")), "event_id", "json").select("event_id", "path", F.col("text").alias("leaf"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 's' WHEN 1 THEN 'n' WHEN 2 THEN 'z' ELSE 't' END AS kind,
    CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN 'null' ELSE 'true' END AS leaf FROM events"""
)
def json_leaf(spark, sf_dir):
    shape = F.element_at(F.array(F.concat(F.lit('"'), F.col("event_type"), F.lit('"')), F.col("user_id").cast("string"), F.lit("null"), F.lit("true")), (F.col("event_id") % 4 + 1).cast("int"))
    leaf = jsonfns.leaf(F.parse_json(shape))
    return table(spark, sf_dir, "events").select("event_id", leaf["kind"].alias("kind"), leaf["text"].alias("leaf"))


@query(
    r"""WITH c AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '=' || p_name WHEN 1 THEN '-' || CAST(p_size AS VARCHAR) WHEN 2 THEN '@' || p_brand ELSE p_name END AS cell FROM part)
    SELECT p_partkey, CASE WHEN regexp_matches(cell, '^[=+\-@\t\r]') AND TRY_CAST(cell AS DOUBLE) IS NULL THEN '''' || cell ELSE cell END AS cell FROM c"""
)
def csv_cell(spark, sf_dir):
    n = F.col("p_partkey") % 4
    raw = F.when(n == 0, F.concat(F.lit("="), "p_name")).when(n == 1, F.concat(F.lit("-"), F.col("p_size").cast("string"))).when(n == 2, F.concat(F.lit("@"), "p_brand")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.csv_cell(raw).alias("cell"))


@query("SELECT o_orderkey, COALESCE(CAST(o_custkey AS VARCHAR), '') || ',' || COALESCE(o_orderstatus, '') || ',' || COALESCE(o_orderpriority, '') AS row_text FROM orders")
def csv_columns(spark, sf_dir):
    from ..sources import sinks

    orders = table(spark, sf_dir, "orders")
    columns = sinks.csv_columns(["o_orderpriority", "o_custkey", "o_orderstatus"], required=["o_custkey"])
    columns = [columns[0], *sorted(columns[1:], key=lambda c: c != "o_orderstatus")]
    cells = [F.coalesce(text.csv_cell(F.col(c).cast("string")), F.lit("")) for c in columns]
    return orders.select("o_orderkey", F.array_join(F.array(*cells), ",").alias("row_text"))


@query("SELECT o_orderkey, CAST(json_extract_string(envelope, '$.extracted.status') AS VARCHAR) AS status, json_extract_string(envelope, '$.url') AS url FROM (SELECT o_orderkey, json_object('url', 'http://ex.com/' || o_orderkey, 'extracted', json_object('status', o_orderstatus)) AS envelope FROM orders)")
def record_envelope(spark, sf_dir):
    from ..sources import sinks

    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("http://ex.com/"), F.col("o_orderkey").cast("string")).alias("url"), F.struct(F.col("o_orderstatus").alias("status")).alias("extracted"))
    lines_ = sinks.envelope(orders, keep=["o_orderkey"])
    return lines_.select("o_orderkey", F.get_json_object("line", "$.extracted.status").alias("status"), F.get_json_object("line", "$.url").alias("url"))
