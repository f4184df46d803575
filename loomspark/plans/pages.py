"""Queries over whole pages: cleaning, views, selectors, site records, differences, crawling, streams, web answers.

Their work is on document trees or ordered state, so most have no SQL; tests hold them against worked examples.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions import text, urls
from ..session import shared_dir
from ..operators import clean, diff, evidence, frontier, selectors, sites
from ..sources import web as answers
from ..sources.tables import table
from ..streaming import watch as streams
from .registry import query
from .web import _CANON, _statuses


@query()
def clean_pages(spark, sf_dir):
    pages = _statuses(table(spark, sf_dir, "pages"))
    cleaned = clean.with_quality(clean.clean(pages), pages)
    return cleaned.select("page_id", "url", "title", "lang", "markdown", "words", "issue", "status", "js_score", F.size("links").alias("n_links"), "error")


@query()
def page_markdown(spark, sf_dir):
    return clean.clean(table(spark, sf_dir, "pages")).select("page_id", "markdown", F.size(text.fields(F.col("markdown"))).alias("words"))


@query()
def page_llm_text(spark, sf_dir):
    return clean.llm_views(clean.clean(table(spark, sf_dir, "pages")))


@query()
def page_reduction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return clean.reduction(clean.clean(pages), pages)


@query()
def page_brand(spark, sf_dir):
    return clean.clean(table(spark, sf_dir, "pages")).select("page_id", "colors", "fonts", "logo", "favicon")


@query()
def page_metadata(spark, sf_dir):
    return clean.clean(table(spark, sf_dir, "pages")).select("page_id", "title", "description", "author", "date", "lang", "site_name", "image")


@query()
def page_scope(spark, sf_dir):
    """Headings only: an included subtree without an excluded one."""
    return clean.clean(table(spark, sf_dir, "pages"), include=("h1",), exclude=("nav",)).select("page_id", "markdown")


def _domain_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").withColumn("domain", urls.domain(F.col("url")))


_DOCUMENT = {"title": {"type": "css", "expr": "article h1"}, "first_link": {"type": "css", "expr": "nav li:nth-of-type(1) a"}, "price": {"type": "css", "expr": ".price", "coerce": "float"}}


@query()
def selector_apply(spark, sf_dir):
    pages = _domain_pages(spark, sf_dir)
    documents = pages.select("domain").distinct().withColumn("fields", F.lit(json.dumps(_DOCUMENT)))
    return selectors.apply_selectors(pages, documents)


@query()
def selector_synthesis(spark, sf_dir):
    samples = _domain_pages(spark, sf_dir).select("domain", F.col("page_id").alias("seq"), "html", F.to_json(F.struct(text.title(F.col("html")).alias("title"))).alias("truth"))
    return selectors.synthesize_by_domain(samples, ["title"])


@query()
def selector_relocate(spark, sf_dir):
    """The heading's element, remembered from an old template, found again in each domain's pages."""
    import pandas as pd

    fp = {"tag": "h1", "id": "", "classes": [], "attrs": {}, "parent": "article", "grandparent": "body", "num_text": False}

    def run(pdf):
        found = selectors.relocate(pdf.sort_values("page_id")["html"].head(3).tolist(), fp, {"type": "css", "expr": "h2.old"})
        return pd.DataFrame({"domain": [pdf["domain"].iloc[0]], "expr": [found["expr"] if found else None]})

    from pyspark.sql import Window

    few = _domain_pages(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy("page_id"))).where("n <= 3")
    return few.select("domain", "page_id", "html").groupBy("domain").applyInPandas(run, "domain string, expr string")


@query()
def site_og(spark, sf_dir):
    return sites.extract(table(spark, sf_dir, "pages").withColumnRenamed("html", "body"), "page_id", "og")


_SITE_URLS = (
    "https://www.amazon.com/dp/B000000001", "https://github.com/o/r/issues/3", "https://pypi.org/project/x/", "https://arxiv.org/abs/1", "https://example.com/products/x",
    "https://news.ycombinator.com/item?id=1", "https://www.youtube.com/watch?v=abc", "https://youtu.be/abc", "https://github.com/o", "ftp://pypi.org/project/x",
)


@query(
    """SELECT page_id, [NULL, 'amazon_product', 'github_repo', 'pypi', 'arxiv', NULL, 'hackernews', 'youtube', 'youtube', NULL, NULL][CAST(page_id % 10 AS INTEGER) + 2] AS extractor FROM pages"""
)
def site_dispatch(spark, sf_dir):
    url = F.element_at(F.array(*map(F.lit, _SITE_URLS)), (F.col("page_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", sites.dispatch(url).alias("extractor"))


@query()
def site_feed(spark, sf_dir):
    """Pages as one-item feeds, read back."""
    item = F.concat(F.lit("<rss version=\"2.0\"><channel><title>F</title><item><title>"), F.regexp_replace("url", "[&<]", "_"), F.lit("</title><link>http://ex.com/</link></item></channel></rss>"))
    return sites.extract(table(spark, sf_dir, "pages").select("page_id", "url", item.alias("body")), "page_id", "rss")


@query()
def word_diff(spark, sf_dir):
    """Each turn of a conversation against the one before it."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    key = F.concat_ws("/", "conv_id", "turn", "role").alias("turn_id")
    turns = table(spark, sf_dir, "conversations").withColumn("old", before).where("old IS NOT NULL")
    return diff.word_diffs(turns.select(key, "old", F.col("text").alias("new")), "turn_id")


@query()
def quote_verify_full(spark, sf_dir):
    """Passages from the middle of every document, with copying's changes, each checked against the whole document."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("url"), F.col("text").alias("markdown"))
    size = F.length("text")
    quote = F.upper(F.substring(F.col("text"), F.floor(size / 3).cast("int") + 1, F.least(F.lit(500), F.floor(size / 3).cast("int"))))
    facts = table(spark, sf_dir, "documents").where(size >= 60).select(F.col("doc_id").alias("url"), F.concat(F.lit('"'), quote, F.lit('."')).alias("quote"))
    return evidence.verify_quotes(facts, documents)


@query(f"WITH {_CANON}, d AS (SELECT CASE WHEN host <> '' THEN regexp_replace(host, ':[0-9]+$', '') END AS host, page_id FROM canonical) SELECT page_id, CASE WHEN host LIKE '%.example.org' THEN 0 ELSE 1 END AS depth FROM d WHERE host LIKE '%.example.org' OR host LIKE '%.example.net'")
def crawl_corpus(spark, sf_dir):
    """A crawl over the page table as its web: sites of .org are seeds and link to those of .net, by host."""
    pages = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    seeds = pages.where(F.col("host").like("%.example.org")).select(F.col("page_id").alias("node"))
    hub = seeds.agg(F.min("node").alias("src"))
    edges = pages.where(F.col("host").like("%.example.net")).select(F.col("page_id").alias("dst")).join(F.broadcast(hub), F.lit(True)).select("src", "dst")
    return frontier.reach(seeds, edges, 3).select(F.col("node").alias("page_id"), "depth")


def _stream(spark, rows, name):
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.mode("overwrite").parquet(f"{base}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{base}/in"), base


@query()
def watch_stream(spark, sf_dir):
    """Every user's events as versions of a page, watched as a stream."""
    events = table(spark, sf_dir, "events")
    source = F.when(F.col("event_type") == "view", "read").otherwise("watch")
    rows = events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("seq"), source.alias("source"), F.concat(F.lit("value is "), F.floor(F.col("value") / 20).cast("string")).alias("markdown"))
    stream, state = _stream(spark, rows, "watch")
    with _state_store(spark):
        return streams.run_once(streams.watch(stream), state)


@query()
def heal_stream(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("event_type").alias("domain"), F.lit("value").alias("field"), F.col("event_id").alias("seq"), (F.col("value") < 8).alias("is_null"))
    stream, state = _stream(spark, rows, "heal")
    with _state_store(spark):
        return streams.run_once(streams.heal_triggers(stream), state)


class _state_store:  # noqa: N801
    """Keyed state of this kind needs the RocksDB store; the session's own choice comes back afterwards."""

    KEY, STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(self.KEY, None)
        self.spark.conf.set(self.KEY, self.STORE)

    def __exit__(self, *error):
        self.spark.conf.unset(self.KEY) if self.before is None else self.spark.conf.set(self.KEY, self.before)


def _answers(spark, sf_dir, backend):
    """One answer of a backend for each part, two hits each."""
    where, title, url, snippet = answers.BACKENDS[backend]
    hit = lambda n: F.struct(F.concat(F.col("p_name"), F.lit(f" {n}")).alias(title), F.concat(F.lit("http://ex.com/"), F.col("p_partkey").cast("string"), F.lit(f"/{n}")).alias(url), F.col("p_brand").alias(snippet))
    body = F.array(hit(1), hit(2))
    for name in reversed(where.split(".")):
        body = F.struct(body.alias(name))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("query"), F.lit(backend).alias("backend"), F.to_json(body).alias("body"))


_HITS = "SELECT CAST(p_partkey AS VARCHAR) AS query, '{}' AS backend, n AS rank, p_name || ' ' || n AS title, 'http://ex.com/' || p_partkey || '/' || n AS url, p_brand AS snippet FROM part, (SELECT unnest([1, 2]) AS n)"


def _register(backend):
    def parse(spark, sf_dir):
        return answers.parse_hits(_answers(spark, sf_dir, backend))

    parse.__name__ = f"search_parse_{backend}"
    query(_HITS.format(backend))(parse)


for _backend in answers.BACKENDS:
    _register(_backend)


@query(_HITS.format("duckduckgo"))
def search_parse_duckduckgo(spark, sf_dir):
    row = lambda n: F.concat(F.lit('<div class="result"><a class="result__a" href="//duckduckgo.com/l/?uddg=http%3A%2F%2Fex.com%2F'), F.col("p_partkey").cast("string"), F.lit(f'%2F{n}&rut=1">'), F.col("p_name"), F.lit(f' {n}</a><a class="result__snippet">'), F.col("p_brand"), F.lit("</a></div>"))
    advert = F.lit('<div class="result"><a class="result__a" href="//duckduckgo.com/y.js?ad=1">ad</a></div>')
    body = F.concat(F.lit("<html><body>"), advert, row(1), row(2))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("query"), F.lit("duckduckgo").alias("backend"), body.alias("body"))
    return answers.parse_hits(parts)


@query("SELECT n_name AS host, 'http://ex.com/' || n_nationkey || '.xml' AS url FROM nation")
def robots_sitemaps(spark, sf_dir):
    body = F.concat(F.lit("User-agent: *\nDisallow: /x # no\n # Sitemap: http://no\n  SITEMAP : http://ex.com/"), F.col("n_nationkey").cast("string"), F.lit(".xml # yes\n"))
    return answers.robots_sitemaps(table(spark, sf_dir, "nation").select(F.col("n_name").alias("host"), body.alias("body")))


@query(
    f"""WITH {_CANON}, c AS (SELECT page_id, path, page_id % 7 AS s, '/' || ['en', 'fr', 'de'][CAST(page_id % 3 AS INTEGER) + 1] || '/' AS closed FROM canonical)
    SELECT page_id, CASE s WHEN 6 THEN TRUE WHEN 5 THEN FALSE ELSE NOT starts_with(path, closed) OR regexp_matches(path, '^/en/.*5$') END AS allowed,
      CASE WHEN s < 5 THEN CAST(page_id % 4 AS DOUBLE) ELSE 0.0::DOUBLE END AS delay FROM c"""
)
def robots_decisions(spark, sf_dir):
    """Every page's own path under rules that close one language to all agents but for pages that end in 5."""
    k, n = F.col("page_id"), (F.col("page_id") % 7)
    closed = F.element_at(F.array(*map(F.lit, ("en", "fr", "de"))), (k % 3 + 1).cast("int"))
    body = F.concat(F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /"), closed, F.lit("/ # closed\nALLOW: /en/*5$\nCrawl-delay: "), (k % 4).cast("string"), F.lit("\n"))
    status = F.when(n == 6, 404).when(n == 5, 500).otherwise(200)
    checks = table(spark, sf_dir, "pages").select("page_id", status.alias("status"), body.alias("body"), urls.path(F.col("url")).alias("path"))
    return answers.robots_allowed(checks, "loom/1").select("page_id", "allowed", "delay")


@query("SELECT page FROM (SELECT DISTINCT 'http://ex.com/p/' || o_custkey AS page FROM orders) ORDER BY page LIMIT 10000")
def sitemap_urls(spark, sf_dir):
    """An index of 25 sitemaps, which list customers' pages; a tour ends at 10,000 pages."""
    orders = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    loc = F.concat(F.lit("<url><loc> http://ex.com/p/"), F.col("o_custkey").cast("string"), F.lit(" </loc></url>"))
    child = orders.groupBy((F.col("o_custkey") % 25).alias("n")).agg(F.array_join(F.collect_list(loc), "").alias("l"))
    child = child.select(F.concat(F.lit("http://ex.com/s"), F.col("n").cast("string")).alias("url"), F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "l", F.lit("</urlset>")).alias("body"))
    entry = F.concat(F.lit("<sitemap><loc>"), F.col("url"), F.lit("</loc></sitemap>"))
    index = child.agg(F.array_join(F.collect_list(entry), "").alias("l")).select(F.lit("http://ex.com/index").alias("url"), F.concat(F.lit("<sitemapindex>"), "l", F.lit("</sitemapindex>")).alias("body"))
    seeds = spark.range(1).select(F.lit("http://ex.com/index").alias("url"))
    return answers.expand_sitemaps(seeds, index.unionByName(child))[0]
