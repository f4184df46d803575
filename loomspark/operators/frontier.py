"""The crawl frontier as a fixpoint: links of pages, and what can be reached from seeds within a depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..session import keep as _keep


#: Text that holds no anchors, whatever it says.
_NO_ANCHORS = r"(?is)<!--.*?-->|<(script|style|noscript|textarea|title|iframe|xmp|noembed|noframes)\b[^>]*+>.*?</\1\s*>"
#: An anchor's attributes, in any order and quoting; the repeated group is possessive, so it does not recurse.
_ANCHOR = r"(?is)<a\s((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
_HREF = r"(?is)(?:^|\s)(?<![\w-])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"


def anchors(html: Column) -> Column:
    """The href values of a page's anchors, entities decoded, in page order."""
    tags = F.regexp_extract_all(F.regexp_replace(html, _NO_ANCHORS, " "), F.lit(_ANCHOR), F.lit(1))
    # Quoted values of other attributes may hold anything, so they are blanked before href is looked for.
    blank = lambda t: F.regexp_replace(t, r"(?is)([\w:-]++)(?<!^href)(?<!\shref)\s*=\s*(?:\"[^\"]*\"|'[^']*')", " ")
    value = lambda t: F.concat(*(F.regexp_extract(blank(t), _HREF, i) for i in (1, 2, 3)))
    return F.filter(F.transform(tags, lambda t: F.trim(text.unescape(value(t)))), lambda h: h != "")


def _once(df: DataFrame, column: str) -> DataFrame:
    """df with a column as a generator's output, so that its expression is not copied into every filter that names it."""
    return df.select(*(c for c in df.columns if c != column), F.explode(F.array(column)).alias(column))


def page_links(pages: DataFrame, scope: urls.Scope | None = None, same_host: bool = True, assets: bool = False) -> DataFrame:
    """Distinct (page_id, link): what pages (page_id, url, html) link to, resolved, canonical and within scope. Native.

    Links of other schemes than http, https and file go, and so do those to other hosts (same_host), out of scope, and to
    files that are no pages (unless assets). Globs and prefixes of the scope meet the canonical form. Null pages have none.
    """
    found = pages.select("page_id", "url", F.explode(F.array_distinct(anchors(F.col("html")))).alias("href"))
    found = _once(found.select("page_id", "url", urls.resolve(F.col("url"), F.col("href")).alias("target")), "target")
    found = found.where(urls.scheme(F.col("target")).isin("http", "https", "file"))
    link = F.col("link")
    found = _once(found.select("page_id", "url", urls.canonicalize(F.col("target")).alias("link")), "link").where(link.isNotNull())
    if same_host:
        found = found.where(urls.host(link) == urls.host(F.col("url")))
    if scope:
        found = found.where(scope.allows(link))
    if not assets:
        found = found.where(~urls.is_asset(link))
    return found.select("page_id", "link").distinct()


def reach(seeds: DataFrame, edges: DataFrame, max_depth: int, max_nodes: int | None = None) -> DataFrame:
    """node and its least depth, from seeds (node) over edges (src, dst), by levels.

    A level is one join of the last frontier with the edges and one anti-join with what has been seen; Spark's
    runtime Bloom filter does the reference's two-tier test where it pays. Levels are checkpointed, so a lost
    executor does not replay the walk. max_nodes stops a crawl that has claimed that many.
    """
    seen = frontier = _keep(seeds.select("node", F.lit(0).alias("depth")).dropDuplicates(["node"]))
    for depth in range(1, max_depth + 1):
        found = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = _keep(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if max_nodes is not None:
            left = max_nodes - seen.count()
            frontier = frontier.orderBy("node").limit(max(0, left))
        if frontier.isEmpty():
            break
        seen = _keep(seen.unionByName(frontier))
    return seen


def harvest(pages: DataFrame, starts: DataFrame, most: int = 3, max_depth: int = 2) -> DataFrame:
    """domain and url of up to `most` pages of each start's (domain, url) own site, nearest first: fresh samples for healing.

    pages (url, html) are what can be read. A page is nearer the fewer links lead to it; of equally near ones the lesser url counts.
    """
    read = pages.select(F.xxhash64("url").alias("page_id"), "url", "html")
    address = read.select("page_id", urls.canonicalize(F.col("url")).alias("src"))
    links = page_links(read).join(address, "page_id").select("src", F.col("link").alias("dst"))
    own = links.join(address.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")
    begin = starts.select("domain", urls.canonicalize(F.col("url")).alias("node"))
    found = reach(begin.select("node"), own, max_depth).join(begin, "node", "left").withColumn("domain", F.coalesce("domain", urls.host(F.col("node"))))
    nth = F.row_number().over(Window.partitionBy("domain").orderBy("depth", "node"))
    return found.withColumn("nth", nth).where(F.col("nth") <= most).select("domain", F.col("node").alias("url"), "depth")
