"""Registered modules, and extractors as table functions against the DataFrame form."""

import json

import pytest

from loomspark.operators import modules, sites


@pytest.fixture
def registry(monkeypatch):
    monkeypatch.setattr(sites, "REGISTRY", list(sites.REGISTRY))
    monkeypatch.setattr(modules, "_modules", {})


def mine():
    return sites.Site("shelf", r"shelf\.example/.+", {"title": sites.css("h2"), "tags": lambda s: s.path or None, "url": sites.page_url})


def test_modules_are_checked(registry):
    ok = modules.Module("a", "1.4.2", "exporter", dict)
    modules.register_module(ok)
    modules.register_module(modules.Module("s", "1.0.0-rc1", "extractor", mine))
    assert modules.module("a") is ok and modules.modules() == ["a", "s"] and modules.modules("extractor") == ["s"] and sites.lookup("shelf")
    for bad in (("", "1.0.0", "proxy"), ("b", "2.0.0", "proxy"), ("b", "0.9.0", "proxy"), ("b", "1.0", "proxy"), ("b", "", "proxy"), ("b", "1.0.0", "printer"), ("a", "1.0.0", "proxy")):
        with pytest.raises(ValueError):
            modules.register_module(modules.Module(*bad, dict))
    with pytest.raises(ValueError):  # the site's name is taken
        modules.register_module(modules.Module("t", "1.0.0", "extractor", mine))
    with pytest.raises(KeyError):
        modules.module("t")
    assert len(modules.KINDS) == 7


def test_extract_in_sql_equals_the_dataframe_form(spark, registry):
    modules.register_module(modules.Module("s", "1.0.0", "extractor", mine))
    modules.register_functions(spark)
    rows = spark.createDataFrame([(1, "https://shelf.example/a/b", "<h2>One</h2>"), (2, "https://shelf.example/c", "<p>none"), (3, None, None)], "k int, url string, body string")
    got = {r.k: r for r in spark.sql("SELECT * FROM extract('shelf', TABLE({rows}))", rows=rows).collect()}
    assert [*got[1].asDict()] == ["k", "url", "title", "tags", "shelf_url", "error"]
    wanted = {r.k: r for r in sites.extract(rows, "k", "shelf").collect()}
    for k, r in got.items():
        record = json.loads(wanted[k].record) if wanted[k].record else {}
        assert r.title == record.get("title") and r.error == wanted[k].error and (json.loads(r.tags) if r.tags else None) == record.get("tags")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    tables = {r.page_id: r for r in spark.sql("SELECT page_id, title, h1, og FROM extract('og', TABLE({pages}))", pages=pages).collect()}
    for r in sites.extract(pages.withColumnRenamed("html", "body"), "page_id", "og").collect():
        record = json.loads(r.record)
        assert tables[r.page_id].title == record.get("title") and tables[r.page_id].h1 == record.get("h1")
    for wrong in ("extract('nobody', TABLE({rows}))", "extract('shelf', TABLE(SELECT 1 AS x))", "extract('shelf', 1)"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT * FROM {wrong}", **({"rows": rows} if "{rows}" in wrong else {})).collect()
