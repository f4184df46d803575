"""Sitemaps and feeds as they come: prefixes, quotes, CDATA, entities, and what is none."""

import pytest
from pyspark.sql import functions as F

from loomspark.operators import sites
from loomspark.sources import xml

NS = "http://www.sitemaps.org/schemas/sitemap/0.9"


@pytest.mark.parametrize(
    "body, urls, maps",
    [
        (f"<urlset xmlns='{NS}'><url><loc>http://a/?x=1&amp;y=2</loc></url><url><loc> http://b </loc><priority>1</priority></url></urlset>", ["http://a/?x=1&y=2", "http://b"], []),
        (f'<?xml version="1.0"?>\n<!-- <sitemapindex> -->\n<sm:urlset xmlns:sm = "{NS}"><sm:url><sm:loc><![CDATA[http://c/]]></sm:loc></sm:url></sm:urlset>', ["http://c/"], []),
        (f"<!DOCTYPE urlset><x:sitemapindex xmlns:x='{NS}'><x:sitemap><x:loc>&#104;ttp://d</x:loc></x:sitemap></x:sitemapindex>", [], ["http://d"]),
        ("\ufeff<urlset><url><loc/></url><url/><url><loc>e</loc></url></urlset>", ["e"], []),
        ("<urlset/>", [], []),
        ("<urlset><url><loc>cut", [], []),
        ("<html><url><loc>x</loc></url></html>", [], []),
        ("<!DOCTYPE u [<!ENTITY a 'b'>]><urlset><url><loc>&a;</loc></url></urlset>", [], []),
        ("no xml", [], []),
        ("", [], []),
        (None, [], []),
    ],
)
def test_sitemaps(spark, body, urls, maps):
    df = spark.createDataFrame([(body,)], "b string").select(xml.urlset(F.col("b")).alias("u"), xml.sitemap_index(F.col("b")).alias("m"))
    r = df.first()
    assert (r.u, r.m) == (urls, maps)
    assert "Python" not in df._jdf.queryExecution().toString()


FEEDS = [
    "<rss version='2.0' xmlns:a='http://www.w3.org/2005/Atom'><channel><title>T &amp; t</title><link>http://l</link><a:link href='http://self' rel='self'/><description>d</description><item><title>one</title><link>http://1</link><pubDate>p</pubDate><description><![CDATA[<b>x</b> y]]></description></item><item/></channel></rss>",
    "<a:feed xmlns:a='x'><a:title type='html'>AT</a:title><a:subtitle>s</a:subtitle><a:link rel='self' href='http://self'/><a:link href='http://alt'/><a:entry><a:title>e1</a:title><a:link rel='alternate' href='http://e'/><a:updated>u</a:updated><a:summary>z</a:summary></a:entry></a:feed>",
    "<rss><channel>" + "".join(f"<item><title>{i}</title></item>" for i in range(70)) + "</channel></rss>",
    "<rss></rss>",
    "<html><channel/></html>",
    "<feed><title>cut",
    "plain",
    None,
]


def test_feeds_equal_the_tree_reader(spark):
    rows = spark.createDataFrame(list(enumerate(FEEDS)), "n int, b string")
    rows = xml.feeds(rows, "b", "f").orderBy("n").collect()
    for body, r in zip(FEEDS, rows, strict=True):
        wanted = sites.feed(body) if body else None
        got = r.f and {k: v for k, v in r.f.asDict(True).items() if v}
        if got and "items" in got:
            got["items"] = [{k: v for k, v in i.items() if v} for i in got["items"]]
        assert (got or None) == (wanted and {k: v for k, v in wanted.items() if v} or None), body
