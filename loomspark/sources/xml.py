"""Sitemaps and feeds by Spark's own XML reader: namespaces with any prefix and quote, CDATA, entities, comments; no Python.

What is no well-formed XML, has another root, or declares entities of its own (they can grow without end) gives nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}
_PROLOG = r"(?s)^[\s\x{FEFF}]*(?:(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*>)\s*)*+"
FEED_ITEMS = 50


def root_name(body: Column) -> Column:
    """The name of the first element, without its prefix; '' if there is none."""
    return F.regexp_extract(body, _PROLOG + r"<(?:[\w.-]+:)?([\w.-]+)", 1)


def _read(body: Column, schema: str | T.StructType) -> Column:
    safe = F.when(~body.rlike(r"(?i)<!ENTITY"), F.regexp_replace(body, _PROLOG, ""))
    return F.from_xml(safe, schema, _OPTIONS)


def _locations(body: Column, root: str, item: str) -> Column:
    found = F.transform(_read(body, f"{item} array<struct<loc:string>>").getField(item), lambda x: F.trim(x["loc"]))
    kept = F.filter(found, lambda x: x.isNotNull() & (x != ""))
    return F.when(root_name(body) == root, F.coalesce(kept, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def urlset(body: Column) -> Column:
    """The page urls of a sitemap."""
    return _locations(body, "urlset", "url")


def sitemap_index(body: Column) -> Column:
    """The sitemaps of an index of sitemaps."""
    return _locations(body, "sitemapindex", "sitemap")


def _kind(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields])


_S = T.StringType()
_LINK = ("link", T.ArrayType(_kind(("_VALUE", _S), ("_href", _S), ("_rel", _S))))
_ITEM = _kind(_LINK, *((n, _S) for n in ("title", "pubDate", "published", "updated", "description", "summary", "content")))
_TOP = _kind(_LINK, *((n, _S) for n in ("title", "description", "subtitle")), ("item", T.ArrayType(_ITEM)), ("entry", T.ArrayType(_ITEM)))
_FEED = T.StructType([*_TOP.fields, T.StructField("channel", _TOP)])


def _plain(text: Column) -> Column:
    """Text in one line, without tags, or null if there is none."""
    line = F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"\s+", " "))
    return F.nullif(line, F.lit(""))


def _link(links: Column) -> Column:
    """The first alternate link, else the first."""
    best = F.get(F.filter(links, lambda x: (F.coalesce(x["_rel"], F.lit("alternate")) == "alternate") & (F.coalesce(x["_href"], F.lit("")) != "")), F.lit(0))
    best = F.coalesce(best, F.get(links, F.lit(0)))
    return F.coalesce(F.nullif(best["_href"], F.lit("")), F.nullif(F.trim(best["_VALUE"]), F.lit("")))


def feeds(rows: DataFrame, body: str, name: str = "feed", items: int = FEED_ITEMS) -> DataFrame:
    """rows with a column more: title, link, description and the first items (title, link, published, summary) of an RSS 2.0 or Atom feed.

    What is no feed has null there.
    """
    read = rows.withColumns({"_whole": _read(F.col(body), _FEED), "_root": root_name(F.col(body))})
    rss = F.col("_root") == "rss"
    top = F.when(rss, F.col("_whole.channel")).when(F.col("_root") == "feed", F.struct(*(F.col(f"_whole.{f.name}") for f in _TOP.fields)))
    top = F.when(F.col("_whole").isNotNull(), top)
    read = read.withColumn("_top", top)

    def item(x: Column) -> Column:
        return F.struct(
            _plain(x["title"]).alias("title"),
            _link(x["link"]).alias("link"),
            F.coalesce(*(_plain(x[n]) for n in ("pubDate", "published", "updated"))).alias("published"),
            F.coalesce(*(_plain(x[n]) for n in ("description", "summary", "content"))).alias("summary"),
        )

    entries = F.coalesce("_top.item", "_top.entry", F.array().cast(T.ArrayType(_ITEM)))
    made = F.struct(
        _plain(F.col("_top.title")).alias("title"),
        _link(F.col("_top.link")).alias("link"),
        F.coalesce(_plain(F.col("_top.description")), _plain(F.col("_top.subtitle"))).alias("description"),
        F.transform(F.slice(entries, 1, items), item).alias("items"),
    )
    return read.withColumn(name, F.when(F.col("_top").isNotNull(), made)).drop("_whole", "_root", "_top")
