"""Reading what the web answers: search results, sitemaps, robots files, url lists, JSON records, packed bodies."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from urllib.parse import parse_qs, unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dom import parse, select
from ..session import spread
from .xml import sitemap_index, urlset

#: Where each search backend keeps its hits, and what it calls title, url and snippet (fixed values).
BACKENDS = {
    "brave": ("web.results", "title", "url", "description"),
    "serper": ("organic", "title", "link", "snippet"),
    "serpapi": ("organic_results", "title", "link", "snippet"),
    "searxng": ("results", "title", "url", "content"),
    "exa": ("results", "title", "url", "text"),
}


def json_hits(body: Column, backend: str, limit: int = 10) -> Column:
    """An array of (title, url, snippet) from a JSON answer, by native JSON functions."""
    where, title, url, snippet = BACKENDS[backend]
    array = F.get_json_object(F.regexp_replace(body, r"^(?:\s*//[^\n]*\n)*", ""), f"$.{where}")
    row = F.from_json(array, f"array<struct<`{title}`:string,`{url}`:string,`{snippet}`:string>>")
    hits = F.transform(row, lambda r: F.struct(r[title].alias("title"), r[url].alias("url"), r[snippet].alias("snippet")))
    return F.slice(F.filter(hits, lambda h: h["url"].isNotNull()), 1, limit)


def parse_hits(answers: DataFrame, limit: int = 10) -> DataFrame:
    """query, backend, rank (from 1), title, url, snippet of answers (query, backend, body)."""
    empty = F.array().cast("array<struct<title:string,url:string,snippet:string>>")
    hits = F.when(F.lit(False), empty)
    for name in BACKENDS:
        hits = hits.when(F.col("backend") == name, json_hits(F.col("body"), name, limit))
    found = answers.where(F.col("backend").isin(*BACKENDS)).select("query", "backend", F.posexplode(F.coalesce(hits, empty)).alias("pos", "h"))
    native = found.select("query", "backend", (F.col("pos") + 1).alias("rank"), "h.title", "h.url", "h.snippet")

    def scrape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(q, b, n, *hit) for q, b, body in zip(pdf["query"], pdf["backend"], pdf["body"], strict=True) for n, hit in enumerate(html_hits(body or "")[:limit], 1)]
            yield pd.DataFrame(rows, columns=["query", "backend", "rank", "title", "url", "snippet"])

    scraped = spread(answers.where("backend = 'duckduckgo'").select("query", "backend", "body")).mapInPandas(scrape, "query string, backend string, rank int, title string, url string, snippet string")
    return native.unionByName(scraped)


def html_hits(body: str) -> list[tuple[str, str, str]]:
    """Results of a page of results; adverts are left out and redirects decoded."""
    root = parse(body)
    out = []
    for n in select(root, ".result"):
        link = next(iter(select(n, "a.result__a")), None)
        url = decode_redirect(link.attrs.get("href", "")) if link else None
        if url:
            out.append((link.text(), url, " ".join(x.text() for x in select(n, ".result__snippet")[:1])))
    return out


def decode_redirect(href: str, depth: int = 4) -> str | None:
    """The target of a redirecting link, which may be wrapped several times; None for an advert."""
    if href.startswith("//"):
        href = "https:" + href
    parts = urlsplit(href)
    if parts.path.startswith("/y.js"):
        return None
    inner = parse_qs(parts.query).get("uddg")
    if inner and depth:
        return decode_redirect(unquote(inner[0]) if "%" in inner[0] else inner[0], depth - 1)
    return href if parts.scheme in ("http", "https") else None


def robots_sitemaps(robots: DataFrame, key: str = "host", body: str = "body") -> DataFrame:
    """key and url of Sitemap lines: comments are cut off, the key's case does not matter."""
    lines = robots.select(key, F.explode(F.split(body, "\n")).alias("line"))
    url = F.trim(F.regexp_extract(F.regexp_replace("line", r"#.*$", ""), r"(?i)^\s*sitemap\s*:\s*(\S+)", 1))
    return lines.select(key, url.alias("url")).where("url <> ''").distinct()


def sitemaps_of(robots: DataFrame, key: str = "host", body: str = "body", site: str = "site") -> DataFrame:
    """robots_sitemaps, and for hosts whose robots file names none (or that have none) the usual place on their site."""
    named = robots_sitemaps(robots, key, body)
    usual = robots.select(key, F.concat(F.regexp_replace(site, "/+$", ""), F.lit("/sitemap.xml")).alias("url")).distinct()
    return named.unionByName(usual.join(named.select(key).distinct(), key, "left_anti"))


def expand_sitemaps(seeds: DataFrame, documents: DataFrame, max_depth: int = 5, max_documents: int = 100, max_urls: int = 10_000) -> tuple[DataFrame, bool]:
    """Page urls under seed sitemaps (url) in documents (url, body), by levels; whether a limit cut it short.

    The limits are the operator's own: a sitemap tour stops at so many documents and urls.
    """
    from ..operators.frontier import _keep

    seen = level = _keep(seeds.select("url").distinct())
    found, read, cut = None, 0, False
    for _ in range(max_depth + 1):
        bodies = _keep(level.join(documents, "url").orderBy("url").limit(max_documents - read))
        n = bodies.count()
        cut |= read + n >= max_documents and level.count() > n
        read += n
        pages = bodies.select(F.explode(urlset(F.col("body"))).alias("page"))
        found = pages if found is None else found.unionByName(pages)
        children = bodies.select(F.explode(sitemap_index(F.col("body"))).alias("url")).distinct()
        level = _keep(children.join(seen, "url", "left_anti"))
        if level.isEmpty() or read >= max_documents:
            break
        seen = _keep(seen.unionByName(level))
    else:
        cut = True
    pages = _keep(found.distinct())
    return pages.orderBy("page").limit(max_urls), cut or pages.count() > max_urls


def robots_groups(body: str) -> list[tuple[list[str], list[tuple[bool, str]], float]]:
    """Groups of a robots file: agents, (allow, path) rules and the delay."""
    groups: list[tuple[list[str], list[tuple[bool, str]], float]] = []
    agents: list[str] = []
    rules: list[tuple[bool, str]] = []
    delay, in_rules = 0.0, False
    for line in body.splitlines():
        key, _, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if in_rules:
                groups.append((agents, rules, delay))
                agents, rules, delay, in_rules = [], [], 0.0, False
            agents.append(value.lower())
        elif key in ("allow", "disallow") and agents:
            in_rules = True
            if value:
                rules.append((key == "allow", value))
        elif key == "crawl-delay" and agents:
            in_rules = True
            delay = float(value) if re.fullmatch(r"\d+(?:\.\d+)?", value) else delay
    if agents:
        groups.append((agents, rules, delay))
    return groups


def robots_decision(status: int, body: str, agent: str, path: str) -> tuple[bool, float]:
    """(allowed, delay): 4xx allows all, other failures nothing; the longest matching rule wins, allow on ties."""
    if not 200 <= status < 300:
        return 400 <= status < 500, 0.0
    groups = robots_groups(body)
    own = [g for g in groups if any(a != "*" and a in agent.lower() for a in g[0])] or [g for g in groups if "*" in g[0]]
    best = (-1, True)
    for _, rules, _ in own:
        for allow, rule in rules:
            pattern = re.escape(rule).replace(r"\*", ".*")
            pattern = pattern[:-2] + r"\Z" if pattern.endswith(r"\$") else pattern
            if re.match(pattern, path):
                best = max(best, (len(rule), allow))
    return best[1], max((g[2] for g in own), default=0.0)


def robots_allowed(checks: DataFrame, agent: str) -> DataFrame:
    """Adds allowed and delay to rows (status, body, path), in Arrow batches."""
    schema = T.StructType([*checks.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("delay", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [robots_decision(int(s), b or "", agent, p) for s, b, p in zip(pdf["status"], pdf["body"], pdf["path"], strict=True)]
            yield pdf.assign(allowed=[a for a, _ in found], delay=[d for _, d in found])

    return checks.mapInPandas(run, schema)


MOST_INFLATED = 64 << 20


def inflate(body: bytes, encodings: str = "") -> bytes:
    """Undo gzip, deflate and zstd, named in a Content-Encoding header (right to left) or seen by gzip's magic number.

    All members of a gzip body are read. ValueError for a body that is cut, that inflates beyond MOST_INFLATED, or of an
    encoding that is not known.
    """
    for name in reversed([e.strip().lower() for e in encodings.split(",") if e.strip()]):
        if name in ("gzip", "x-gzip"):
            body = _members(body)
        elif name == "deflate":
            try:
                body = _bounded(zlib.decompressobj(), body)[0]
            except zlib.error:
                body = _bounded(zlib.decompressobj(-15), body)[0]
        elif name == "zstd":
            import zstandard

            reader = zstandard.ZstdDecompressor().stream_reader(body, read_across_frames=True)
            body = reader.read(MOST_INFLATED + 1)
            if len(body) > MOST_INFLATED:
                raise ValueError("a body inflates beyond the limit")
        elif name != "identity":
            raise ValueError(f"unsupported encoding {name}")
    return _members(body) if body[:2] == b"\x1f\x8b" else body


def _members(body: bytes) -> bytes:
    out = b""
    while body[:2] == b"\x1f\x8b":
        part, body = _bounded(zlib.decompressobj(31), body, MOST_INFLATED - len(out))
        out += part
    return out


def _bounded(reader, body: bytes, most: int | None = None) -> tuple[bytes, bytes]:
    """What a body inflates to, and what comes after it."""
    most = MOST_INFLATED if most is None else most
    out = reader.decompress(body, most + 1)
    if reader.unconsumed_tail or len(out) > most:
        raise ValueError("a body inflates beyond the limit")
    if not reader.eof:
        raise ValueError("a body is cut")
    return out, reader.unused_data


def is_pdf(body: Column, content_type: Column) -> Column:
    return F.lower(F.coalesce(content_type, F.lit(""))).startswith("application/pdf") | F.coalesce(body.startswith("%PDF-"), F.lit(False))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """url: the trimmed, non-blank lines of a text file."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")
