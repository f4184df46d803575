from pyspark.sql import functions as F

from loomspark.functions import small, urls
from loomspark.operators import ledger
from loomspark.session import shared_dir, spread


def one(spark, values, make):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_ranges_and_paths(spark):
    days = ["2024-01-01", "2024-01-31T10:00", "2024-02-01", "soon", None]
    assert one(spark, days, lambda c: small.in_range(c, "2024-01-01", "2024-01-31")) == [True, True, False, True, True]
    assert one(spark, days[:3], lambda c: small.in_range(c, None, "2024-01-15")) == [True, False, False]
    assert one(spark, ["http://x/", "http://x/a/Login", "http://x/a", "http://x/logout"], small.low_value_path) == [True, True, False, False]
    assert one(spark, ["http://x/", "http://x/a/logout"], small.unsafe_action_path) == [False, True]


def test_safe_addresses():
    for good in ("https://example.com/a", "http://8.8.8.8:80/", "http://[2606:4700::1111]/"):
        assert small.fetch_allowed(good), good
    for bad in ("", None, "file:///etc", "http://localhost", "http://a.localhost/", "http://10.0.0.1", "http://127.1", "http://2130706433/", "http://0x7f.1/", "http://[::ffff:127.0.0.1]/", "http://169.254.169.254", "http://224.0.0.1/", "http://[::1/", "http://x.internal"):
        assert not small.fetch_allowed(bad), bad


def test_texts(spark):
    assert small.resolve("http://a/b/c", "../d?e#f") == "http://a/d?e#f" and small.resolve("http://a", "http://[") == "http://["
    assert small.cap_utf8("é" * 200) == "é" * 128 and small.cap_utf8(None) is None
    issue = one(spark, ["robots: no: way", "timeout"], small.split_issue)
    assert [tuple(x) for x in issue] == [("robots", "no: way"), ("timeout", "")]
    assert one(spark, ["Robots said no", "HTTP login-required", "x"], small.issue_bucket) == ["robots", "login-required", "error"]
    ids = one(spark, ["https://www.youtube.com/watch?v=a-b", "https://pypi.org/project/x/", "https://e.com/itm/x/123456", "https://amazon.com/dp/B012345678?x"], small.url_ids)
    assert [next(v for v in i if v) for i in ids] == ["a-b", "x", "123456", "B012345678"]


def test_guards(spark):
    log = spark.createDataFrame([("r", 1, "launch"), ("r", 2, "running"), ("r", 3, "done"), ("r", 4, "running"), ("s", 1, "running")], "run string, n int, status string")
    assert [(r.run, r.n, r.valid) for r in ledger.valid_transitions(log, "run", ["n"]).orderBy("run", "n").collect()] == [("r", 1, True), ("r", 2, True), ("r", 3, True), ("r", 4, False), ("s", 1, False)]
    fetches = spark.createDataFrame([("h", i) for i in range(5)], "host string, n int")
    assert [r.earliest for r in ledger.schedule(fetches, "host", ["n"]).orderBy("n").collect()] == [0.0, 0.0, 0.0, 1.0, 2.0]


def test_spread_and_shared_folder(spark):
    assert spread(spark.range(3).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(99).repartition(9)).rdd.getNumPartitions() == 9
    assert shared_dir(spark) == shared_dir(spark)


def test_page_files(spark, tmp_path):
    from loomspark.sources.tables import page_files

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.html").write_text("<p>é</p>")
    (tmp_path / "y.html").write_bytes(b"%PDF-1.4 \xff")
    got = {r.url.rsplit("/", 1)[1]: (r.html, r.content_type) for r in page_files(spark, str(tmp_path)).collect()}
    assert got == {"x.html": ("<p>é</p>", "text/html"), "y.html": (None, "application/pdf")}


def test_what_callers_bring(spark):
    import json

    import pytest

    from loomspark.operators import clean, selectors

    html = "<body><div><div><section><ul><li class=a>one</li><li>two</li></ul></section></div></div><script>x</script><p>far</p></body>"
    assert selectors.trimmed(html, ["one"]) == '<div><div><section><ul><li class="a">one</li><li>two</li></ul></section></div></div>'
    records = spark.createDataFrame([(1, '{"a": 1}'), (2, "{}")], "id int, record string")
    got = {r.id: (r.record, r.error) for r in selectors.transform_records(records, "id", lambda r: {"b": r["a"] + 1}).collect()}
    assert got == {1: ('{"b": 2}', None), 2: (None, "KeyError: 'a'")}
    answers = iter(["no", '{"n": "x"}', '{"n": "3,5", "m": ""}'])
    asked = []
    schema = {"type": "object", "required": ["n", "m"], "properties": {"n": {"type": "number"}, "m": {"type": "string"}}}
    record = selectors.extract_with_repair("page", schema, lambda q: asked.append(q) or next(answers), side={"m": {"v": "side"}}, paths={"m": "$.m.v"}, hints={"n": {"coerce": "float"}})
    assert record == {"n": 3.5, "m": "side"} and len(asked) == 3 and "Wrong so far" in asked[1]
    with pytest.raises(ValueError):
        selectors.extract_with_repair("page", schema, lambda q: "{}", tries=2)
    page = clean.clean_page("<h1>T</h1><p>text</p>", "http://x/")
    assert clean.render({**page, "url": "http://x/"}, "llm").startswith("> Source") and json.loads(clean.render(page, "json"))["markdown"] == clean.render(page, "markdown")
    assert clean.prepare("# x", "markdown") == ("# x", None) and clean.prepare("<p>y</p>", "html")[0] == "y"
    for call in (lambda: clean.render(page, "pdf"), lambda: clean.prepare("", "csv")):
        with pytest.raises(ValueError):
            call()


def test_resolve_is_rfc_3986(spark):
    """The examples of the standard's section 5.4, without fragments, with http://a/b/c/d;p?q as base."""
    cases = {
        "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y",
        "#s": "http://a/b/c/d;p?q", "g#s": "http://a/b/c/g", ";x": "http://a/b/c/;x", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/",
        "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g",
        "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y", "g?y/../x": "http://a/b/c/g?y/../x", "mailto:x": "mailto:x",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "r string").select("r", urls.resolve(F.lit("http://a/b/c/d;p?q"), F.col("r")).alias("u")).collect()
    assert {r.r: r.u for r in rows} == cases


def test_canonical_urls_of_all_kinds(spark):
    vectors = {
        "HTTP://EX.com:80/a?utm_x=1&b=2": "http://ex.com/a?b=2",
        "http://ex.com/a?z=1&b=2": "http://ex.com/a?b=2&z=1",
        "http://ex.com": "http://ex.com/",
        "http://ex.com/a b/é": "http://ex.com/a%20b/%C3%A9",
        "http://ex.com/a%20b/%C3%A9": "http://ex.com/a%20b/%C3%A9",
        "http://u:p@ex.com/": "http://u:p@ex.com/",
        "http://u@ex.com/": "http://u@ex.com/",
        "http://ex.com/(x)!*'": "http://ex.com/(x)!*'",
        'http://ex.com/"(x)!+': "http://ex.com/%22%28x%29%21+",
        "http://[::1]:80/a": "http://[::1]/a",
        "file:///a b": "file:///a%20b",
        **dict.fromkeys(["", "://bad", "http://", "http://ex.com/%4", "http://a b.com/", "http://ex.com:x/", "http://ex.com/\x01"]),
    }
    df = spark.createDataFrame([(u,) for u in vectors], "u string")
    from loomspark.functions import urls

    assert {r.u: r.c for r in df.select("u", urls.canonicalize(F.col("u")).alias("c")).collect()} == vectors


def test_texts_that_hold_quotes_of_any_length(spark):
    import random

    from loomspark.operators import evidence

    rng = random.Random(3)
    words = ["a", "bb", "ccc", "dd", "e"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(80)]
    quotes = [t[i : i + n] for t in texts[::4] for i, n in ((0, 3), (1, 9), (2, 14), (0, 40))] + ["nowhere to be found", ""]
    pages = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "id int, t string")
    asked = spark.createDataFrame([(i % 50, q) for i, q in enumerate(quotes)], "n int, q string")
    got = sorted((r.id, r.n, r.q) for r in evidence.containing(pages, "t", asked, "q").collect())
    assert got == sorted((i, n % 50, q) for i, t in [*enumerate(texts), (0, texts[0])] for n, q in enumerate(quotes) if q in t)


def test_containing_takes_long_texts_in_proportion(spark):
    """A text of 60,000 different words: comparing all its runs with each other takes minutes."""
    import time

    from loomspark.operators import evidence

    pages = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60_000)))], "id int, t string")
    asked = spark.createDataFrame([(1, "w59990 w59991 w59992 w59993 w59994 w59995"), (2, "w1 w3 w4 w5 w6 w7")], "n int, q string")
    began = time.perf_counter()
    assert [(r.id, r.n) for r in evidence.containing(pages, "t", asked, "q").collect()] == [(1, 1)]
    assert time.perf_counter() - began < 30


def test_watching_asks_the_state_once_a_batch():
    import pandas as pd

    from loomspark.streaming.watch import Watcher

    class State:
        value, calls = None, 0

        def exists(self):
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    watcher = Watcher()
    watcher.last = State()
    rows = pd.DataFrame([(i, "read" if i % 3 == 1 else "watch", f"v{i // 4}") for i in range(40)], columns=["seq", "source", "markdown"])
    halves = [list(watcher.handleInputRows(("u",), iter([rows[at : at + 20]]), None))[0] for at in (0, 20)]
    assert [len(h) for h in halves] == [13, 14]
    assert [bool(b) for h in halves for b in h["baseline"]] == [True] + [False] * 26
    assert sum(bool(c) for h in halves for c in h["changed"]) == 9 and watcher.last.value == ("v9",) and watcher.last.calls == 3


def test_answers_in_one_partition_are_read_by_all_cores(spark):
    from loomspark.sources import web

    body = '<div class="result"><a class="result__a" href="http://a/">x</a></div>'
    answers = spark.range(64, numPartitions=1).selectExpr("cast(id as string) query", "'duckduckgo' backend", f"'{body}' body")
    hits = web.parse_hits(answers)
    assert hits.count() == 64
    assert hits.selectExpr("spark_partition_id() p").distinct().count() == min(64, spark.sparkContext.defaultParallelism) or spark.sparkContext.defaultParallelism == 1
