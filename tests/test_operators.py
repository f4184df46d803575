import gzip
import json

import pytest
import zstandard
from pyspark.sql import functions as F

from loomspark.operators import clean, diff, dom, evidence, frontier, ledger, lines, rank, recdiff, selectors, sites
from loomspark.sources import sinks, web
from loomspark.streaming import watch


def test_word_diff():
    assert diff.word_diff("a b", "a b") == []
    assert diff.word_diff("the cat sat", "the dog sat") == ["- cat", "+ dog"]
    assert diff.word_diff("a b", "a x b") == ["+ x"]
    assert diff.word_diff("a b c d", "b c e d") == ["- a", "+ e"]
    shared = " ".join(f"w{i}" for i in range(5000))
    assert diff.word_diff(f"{shared} old {shared}", f"{shared} new {shared}") == ["- old", "+ new"]
    with pytest.raises(ValueError, match="too large"):
        diff.word_diff(" ".join(f"a{i}" for i in range(2001)), " ".join(f"b{i}" for i in range(2001)))


def records(spark, rows):
    return spark.createDataFrame(rows, "sku string, price double, name string, tags array<string>, more struct<a:string>")


def test_record_differences(spark):
    prev = records(spark, [("a", 19.99, "A", ["x"], ("1",)), ("b", 5.0, "  hello\n\tworld  ", None, None), ("c", 1.0, "C", None, ("z",))])
    cur = records(spark, [("a", 17.99, "A", ["x"], ("1",)), ("b", 5.0, "hello world", None, None), ("d", 1.0, "D", None, None)])
    kinds = recdiff.row_kinds(prev, cur, "sku")
    assert {(r.key, r.kind) for r in kinds.collect()} == {("a", "changed"), ("c", "gone"), ("d", "added")}
    assert recdiff.counts(kinds).first().asDict() == {"added": 1, "changed": 1, "gone": 1}
    assert [tuple(r) for r in recdiff.field_changes(prev, cur, "sku").collect()] == [("a", "price", "19.99", "17.99", False)]
    assert {r.line for r in recdiff.report_lines(kinds, recdiff.field_changes(prev, cur, "sku")).collect()} == {"+ d", "- c", "~ a price: 19.99 -> 17.99"}
    assert recdiff.row_kinds(prev, cur, "sku", ignore=("price",)).where("kind = 'changed'").count() == 0
    assert {r.kind for r in recdiff.row_kinds(prev, cur, "sku", no_gone=True).collect()} == {"changed", "added"}
    unseen = spark.createDataFrame([("c",)], "k string")
    assert recdiff.row_kinds(prev, cur, "sku", unseen=unseen).where("kind = 'gone'").count() == 0
    assert recdiff.row_kinds(prev, prev, "sku").count() == 0
    assert [r.kind for r in recdiff.ordered_rows(kinds, 2).collect()] == ["added", "changed"]
    texts, numbers = spark.createDataFrame([("a", "19.99")], "sku string, p string"), spark.createDataFrame([("a", 19.99)], "sku string, p double")
    assert recdiff.row_kinds(texts, numbers, "sku").count() == 1


def test_ledger(spark):
    runs = spark.createDataFrame([("2026-10-01 20:30:00", "scrape", "done", 1, 0, 2, 3, 0.5), ("2026-10-01 20:30:00", "watch", "done", 1, 0, 2, 3, 0.5)], "ts string, command string, status string, pages_ok int, pages_err int, prompt_tokens int, completion_tokens int, usd double")
    runs = runs.withColumn("ts", F.to_timestamp("ts"))
    for minutes, day in ((420, "2026-10-02"), (0, "2026-10-01"), (-300, "2026-10-01")):
        assert [str(r.day) for r in ledger.activity(runs, minutes).collect()] == [day]
    outcomes = spark.createDataFrame([(i, "d", i >= 35) for i in range(51)], "seq int, domain string, is_null boolean")
    fired = {r.seq for r in ledger.null_rates(outcomes, ["domain"], ["seq"], F.col("is_null")).where("trigger").collect()}
    assert fired == {50}
    resets = ledger.null_rate_resets(spark.createDataFrame([(i, "d", True) for i in range(25)], "seq int, domain string, is_null boolean"), ["domain"], "seq", "is_null").first()
    assert (resets.triggers, resets.in_ring) == (2, 5)
    facts = spark.createDataFrame([("r", i) for i in range(12)], "run string, n int")
    old = spark.createDataFrame([("r", "f9"), ("r", "f10")], "run string, fact_id string")
    assert [r.fact_id for r in ledger.mint_ids(facts, "run", ["n"], old).orderBy("n").collect()][:2] == ["f11", "f12"]
    reports = spark.createDataFrame([("h", i, s, a) for i, (s, a) in enumerate([(429, None), (503, None), (200, None), (429, 30), (200, None), (404, None)])], "host string, n int, status int, retry_after int")
    assert ledger.throttle(reports, "host", "n").first().delay == 22.5
    calls = spark.createDataFrame([(i, 1, 0.4) for i in range(4)], "i int, k int, usd double")
    assert [r.admitted for r in ledger.within_ceiling(calls, ["k"], ["i"], "usd", 1.0).orderBy("i").collect()] == [True, True, False, False]


def test_ranking(spark):
    lists = spark.createDataFrame([(1, 5, "a"), (2, 5, "a"), (3, 5, "a"), (1, 1, "b"), (1, 9, "b")], "list_id int, rank int, url string")
    got = {r.url: (r.score, r.lists, r.best_rank) for r in rank.fuse(lists).collect()}
    assert got["a"] == (round(3 / 65, 10), 3, 5) and got["b"] == (round(1 / 61, 10), 1, 1)
    assert [r.url for r in rank.order(rank.fuse(lists)).collect()] == ["a", "b"]
    queries = spark.createDataFrame([(1, "Best laptops 2026?"), (2, "2026 best LAPTOPS"), (3, "C# generics"), (4, "C generics"), (5, "?!")], "i int, q string").withColumn("g", F.lit(0))
    assert [r.q for r in rank.dedupe_queries(queries, None, "q", ["g"], ["i"]).orderBy("i").collect()] == ["Best laptops 2026?", "C# generics", "C generics"]


PAGE = "The [tool](http://x) is **not** “unsupported” by us — it’s made for 2025. It costs $1,000,000 or 2.5 million, they say.\n> Quoted line | with a snake_case_name and 30 * 2 things…\n| cell one | cell two is here |"


@pytest.mark.parametrize(
    "quote, found",
    [
        ('the TOOL is not "unsupported" by us', True), ("by us - it's made for 2025.", True), ("“It costs $1,000,000 or 2.5 million”", True), ("it costs $1,000,000 or 2.5 million, they say.", True), ("is not unsupport", False),
        ("It costs $1,000", False), ("supported\" by us - it's made", False), ("5 million, they say.", False), ("made for 202", False), ("too short", False), ("x" * 700, False),
        ("quoted line | with a snake_case_name", True), ("with a snakecasename and 30", False), ("30 * 2 things... cell one cell two is here", True), ("30  2 things... cell one", False),
    ],
)
def test_quotes(quote, found):
    assert evidence.quote_in(evidence.normal_text(PAGE), quote) is found


def test_settling(spark):
    facts = spark.createDataFrame([("r", f"f{i}", "a.example", s, "c", "n") for i, s in enumerate(["unverified", "unverified", "unverified", "softened", "unverified"])], "run_id string, fact_id string, domain string, status string, claim string, note string")
    rows = [("f0", "f9", "b.example", "contradicts"), ("f1", "f7", "c.example", "supports"), ("f2", "f8", "a.example", "supports"), ("f3", "f7", "c.example", "supports"), ("f4", None, "b.example", "contradicts")]
    found = spark.createDataFrame([("r", *x) for x in rows], "run_id string, fact_id string, other_id string, domain string, stance string")
    got = {r.fact_id: (r.status, r.note) for r in evidence.settle(facts, found).collect()}
    assert got == {"f0": ("contested", "n"), "f1": ("verified", "corroborated by f7 (c.example)"), "f2": ("softened", "Per a.example: c"), "f3": ("softened", "n"), "f4": ("softened", "Per a.example: c")}
    text, sources, unknown = evidence.resolve_citations("A [f2, f1] b [f1] c [f9].", {"f1": "one", "f2": "two"})
    assert text == "A [^1][^2] b [^2] c ." and sources == ["[^1]: two", "[^2]: one"] and unknown == ["f9"]


def test_frontier(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (9, 1)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (1,)], "node long")
    assert {(r.node, r.depth) for r in frontier.reach(seeds, edges, 3).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert frontier.reach(seeds, edges, 9, max_nodes=2).count() == 2


def test_lines(spark):
    merged = spark.range(1).select(lines.merge_stats(F.array(*map(F.lit, ["12", "Users", "More", "7%", "8", "Sites", "9"]))).alias("m")).first().m
    assert merged == ["Users: 12", "More", "7%", "Sites: 8", "9"]


def test_selectors_engine():
    root = dom.parse('<div id=a class="x y"><p>1<p data-k="Vw">2</p><ul><li>3<li class=z>4</ul></div><p>5')
    pick = lambda s: [n.text() for n in dom.select(root, s)]
    assert pick("#a > p") == ["1", "2"] and pick("div.x.y li:nth-of-type(2)") == ["4"] and pick('[data-k="Vw"]') == ["2"] and pick("[data-k*=vW i]") == ["2"]
    assert pick("li.z, p:nth-of-type(1)") == ["1", "4", "5"] and pick("div li") == ["3", "4"] and pick("[data-k^=V][data-k$=w]") == ["2"]
    for bad in ("p::before", "p +", "", "p[", ":hover"):
        with pytest.raises(dom.SelectorError):
            dom.compile_selector(bad)


HIDDEN = '<body><p style="display: none">a</p><p hidden>b</p><p style="font-size:0">c</p><p style="opacity:0.5">kept one</p><p style="display:flex">kept two</p><p aria-hidden="true">kept three</p></body>'


def test_cleaning():
    page = clean.clean_page(HIDDEN, "http://x/")
    assert page["hidden_removed"] == 3 and all(k in page["markdown"] for k in ("kept one", "kept two", "kept three")) and not any(f"{k}\n" in page["markdown"] + "\n" for k in ("a", "b", "c"))
    html = "<html lang=en><head><title>T &amp; t</title><meta property=og:description content=D><link rel=icon href=/f.ico></head><body><nav>menu</nav><article><h1>H</h1><p>One <b>two</b> <a href=/l>link</a>.</p><ul><li>x<ul><li>y</ul></ul><table><tr><th>a<th>b<tr><td colspan=2>c</table><pre>code\n x</pre></article><footer>f</footer></body></html>"
    page = clean.clean_page(html, "http://ex.com/d/")
    assert page["markdown"] == "# H\n\nOne **two** [link](http://ex.com/l).\n\n- x\n  - y\n\n| a | b |\n| --- | --- |\n| c | c |\n\n```\ncode\n x\n```"
    assert (page["title"], page["description"], page["lang"], page["favicon"], page["links"]) == ("T & t", "D", "en", "http://ex.com/f.ico", ["http://ex.com/l"])
    assert clean.clean_page("<title>App</title><div id=root></div><noscript>Please enable it.</noscript>", "http://x")["markdown"] == "Please enable it."
    scoped = clean.clean_page(html, "http://ex.com/", include=("h1", "::bad"), exclude=("nav",))
    assert scoped["markdown"] == "# H" and clean.clean_page(html, "http://ex.com/", include=(".none",))["markdown"] == ""
    body, links = clean.llm_body("# T\n\n![](x)\nAcme\nBeta\n\n12.5\nUsers\n\nSame line here.\nSame line here.\n| a |  b |\n|---|---|\n[t](http://u) and **b**\n[next](/page/2)")
    assert body == "# T\n\nUsers: 12.5\n\nSame line here.\n| a | b |"
    assert links == [("t", "http://u")]
    assert clean.cap_bytes("é" * 20 + "\n" + "x" * 30, 60).endswith("é")


def test_sites(spark):
    html = '<script type="application/ld+json">{"@graph":[{"@type":"WebSite"},{"@type":["Product"],"name":"W","offers":[{"price":"9.50","priceCurrency":"EUR","availability":"https://schema.org/InStock"}]}]}</script>'
    assert sites.extract_record("ecommerce_product", html, "http://s/x") == {"name": "W", "price": {"amount": 9.5, "currency": "EUR"}, "availability": "InStock", "url": "http://s/x"}
    assert sites.extract_record("pypi", json.dumps({"info": {"name": "n", "version": "1", "author": ""}}), "https://pypi.org/project/n/") == {"name": "n", "version": "1", "url": "https://pypi.org/project/n/"}
    assert sites.extract_record("pypi", "nonsense", "https://pypi.org/project/n/") is None
    items = "".join(f"<item><title>{i}</title></item>" for i in range(60))
    assert len(sites.feed(f"<rss><channel><title>F</title>{items}</channel></rss>")["items"]) == 50
    assert sites.feed("<!DOCTYPE x [<!ENTITY a 'b'>]><rss/>") is None and sites.feed("<html/>") is None
    assert sites.video_id("https://youtu.be/abc") == "abc" and sites.video_id("https://www.youtube.com/watch?v=q&t=1") == "q"
    assert sites.balanced('x {"a": "}\\"{", "b": {}} y', 0) == '{"a": "}\\"{", "b": {}}' and sites.balanced("{ {", 0) is None
    assert len({s.name for s in sites.REGISTRY}) == 27 and sum(s.opt_in for s in sites.REGISTRY) == 9
    with pytest.raises(ValueError):
        sites.register(sites.Site("pypi", "", {"x": sites.css("a")}))
    with pytest.raises(KeyError):
        sites.lookup("none")
    bodies = spark.createDataFrame([(1, "https://github.com/o/r", '{"full_name":"o/r"}'), (2, "https://nowhere.example/", ""), (3, None, None)], "id int, url string, body string")
    got = {r.id: (r.extractor, r.error) for r in sites.extract(bodies, "id").collect()}
    assert got == {1: ("github_repo", None), 2: (None, "no extractor"), 3: (None, "no extractor")}


A = '<main><div class="product"><h1 id="t">{n}</h1><span class="price">{p}</span><em>{p}0</em></div></main>'
B = '<section><div class="item box"><h2>{n}</h2><b class="price">{p}</b></div><p>other 1</p></section>'


def test_learning_and_moving_selectors():
    samples = [{"html": A.format(n=f"Name {i}", p=f"1{i}.50"), "truth": {"name": f"Name {i}", "price": 10.5 + i}} for i in range(3)]
    made = selectors.synthesize(samples, ["name", "price", "none"], {"price": {"coerce": "float"}})
    assert made["name"]["expr"] == "#t" and set(made) == {"name", "price"}
    assert selectors.apply_document(samples[1]["html"], made) == ({"name": "Name 1", "price": 11.5}, [])
    root = dom.parse(samples[0]["html"])
    fp = selectors.fingerprint(dom.first(root, ".price"))
    moved = selectors.relocate([B.format(n="N", p="3.10"), B.format(n="M", p="4.20")], fp, {"coerce": "float"})
    assert moved is None or moved["expr"] in (".price", "b.price")
    again = selectors.relocate([A.format(n="N", p="3.10").replace("<em>", "<i>"), A.format(n="M", p="4.20").replace("<em>", "<i>")], fp, {"coerce": "float"})
    assert again["expr"] == ".price" and selectors.relocate([A.format(n="N", p="3.1")], fp, {}) is None
    pages = [A.format(n=n, p=p).replace("<em>", "<i>") for n, p in (("N", "3.10"), ("M", "4.20"), ("K", "5.00"))]
    assert selectors.relocate(pages, fp, {"coerce": "float"}, [3.1, 4.2, None])["expr"] == ".price"
    assert selectors.relocate(pages, fp, {"coerce": "float"}, [3.1, 9.9, 5.0])["expr"] == ".price"  # two of three are enough
    assert selectors.relocate(pages, fp, {"coerce": "float"}, [3.1, 9.9, 8.0]) is None and selectors.relocate(pages, fp, {"coerce": "float"}, [3.1, None, None]) is None
    assert [selectors.need(n) for n in (1, 2, 3, 5)] == [1, 2, 2, 4] and selectors.jaccard([], []) == 0 and selectors.jaccard(["a", "b"], ["b", "c"]) == 1 / 3
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"enum": ["x"]}}, "additionalProperties": False}
    assert selectors.validate({"a": 1, "b": "x"}, schema) == [] and len(selectors.validate({"b": "y", "c": 1}, schema)) == 3 and selectors.validate({"a": True}, schema)
    assert not selectors.strict_schema(schema) and selectors.strict_schema({**schema, "required": ["a", "b"]})
    assert selectors.parse_draft('```json\n{"type":"object","properties":{"a":{}}}\n```')["type"] == "object"
    for bad in ('{"type":"object","properties":{"a":{"$ref":"x"}}}', '{"type":"array"}', "[]"):
        with pytest.raises(ValueError):
            selectors.parse_draft(bad)


def test_web_answers(spark, tmp_path):
    assert web.decode_redirect("//d.com/l/?uddg=https%3A%2F%2Fa.com%2Fx%3Fy%3D1") == "https://a.com/x?y=1" and web.decode_redirect("/y.js?ad") is None
    robots = "User-agent: *\nDisallow: /private\nAllow: /private/ok\nCrawl-delay: 2"
    assert web.robots_decision(200, robots, "x", "/private/a") == (False, 2.0) and web.robots_decision(200, robots, "x", "/private/ok")[0]
    assert web.robots_decision(404, "", "x", "/")[0] and not web.robots_decision(500, "", "x", "/")[0]
    assert web.inflate(gzip.compress(b"abc")) == b"abc" and web.inflate(gzip.compress(gzip.compress(b"abc")), "gzip") == b"abc"
    with pytest.raises(ValueError):
        web.inflate(b"x", "br")
    assert web.inflate(gzip.compress(b"abc") + gzip.compress(b"def")) == b"abcdef"
    packed = zstandard.ZstdCompressor().compress(bytes(web.MOST_INFLATED + 1))
    for body, named in ((packed, "zstd"), (gzip.compress(bytes(web.MOST_INFLATED + 1)), "gzip"), (gzip.compress(b"abc" * 99)[:-20], "gzip")):
        with pytest.raises(ValueError):
            web.inflate(body, named)
    hosts = spark.createDataFrame([("a", "https://a/", "Sitemap: https://a/own.xml"), ("b", "https://b", "User-agent: *"), ("c", "https://c/", None)], "host string, site string, body string")
    assert sorted(map(tuple, web.sitemaps_of(hosts).collect())) == [("a", "https://a/own.xml"), ("b", "https://b/sitemap.xml"), ("c", "https://c/sitemap.xml")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "=x", None), (1, "a,b", "c")], "b int, a string, c string")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "csv"), ["b"])
    text = next((tmp_path / "csv").glob("part-*")).read_text()
    assert text.splitlines() == ["b,a,c", "2,'=x,", '1,"a,b",c']
    with pytest.raises(TypeError):
        sinks.write_csv(df.withColumn("d", F.array("a")), str(tmp_path / "no"), [])
    assert json.loads(sinks.json_array(df)) == [{"b": 2, "a": "=x"}, {"b": 1, "a": "a,b", "c": "c"}] and sinks.json_array(df.limit(0)) == "[]"
    assert sum(r.sent for r in sinks.pipe_to(df, ["cat"]).collect()) == 2
    seen = []
    statuses = iter([503, 429, 204])
    assert sinks.deliver(lambda h, b: seen.append(h) or next(statuses), "m1", b"{}", b"k", 5) == (True, 3)
    assert len({h["webhook-id"] for h in seen}) == 1 and seen[0]["webhook-signature"] == sinks.sign(b"k", "m1", 5, b"{}")
    assert sinks.deliver(lambda h, b: 404, "m", b"", None, 1) == (False, 1) and sinks.deliver(lambda h, b: 500, "m", b"", None, 1) == (False, 4)


def test_watching():
    first = watch.compare(None, "a b")
    assert first["baseline"] and not first["changed"]
    assert not watch.compare("a b", "a  b\n")["changed"]
    moved = watch.compare("a b", "a c d")
    assert moved["changed"] and moved["diff"] == "- b\n+ c d" and moved["words_delta"] == 1


def test_watch_stream_keeps_its_state(spark, tmp_path):
    schema = "url string, seq long, source string, markdown string"
    put = lambda n, rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    put(1, [("u", 1, "watch", "one"), ("v", 1, "", "x")])
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert {(r.url, r.baseline) for r in watch.run_once(watch.watch(stream), str(tmp_path / "kept")).collect()} == {("u", True), ("v", True)}
    put(2, [("u", 2, "read", "between"), ("u", 3, "watch", "two")])
    rows = watch.run_once(watch.watch(stream), str(tmp_path / "kept")).where("NOT baseline").collect()
    assert [(r.url, r.seq, r.changed, r.diff) for r in rows] == [("u", 3, True, "- one\n+ two")]
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_relocation_sees_attribute_values():
    """Two elements that differ in the value of one attribute only: the one with the remembered value is found."""
    page = '<div class=box><span itemprop="{a}">10.00</span><span itemprop="{b}">12.00</span></div>'
    fp = selectors.fingerprint(dom.first(dom.parse(page.format(a="price", b="shipping")), "[itemprop=price]"))
    spec = {"coerce": "float"}
    for order in ({"a": "price", "b": "shipping"}, {"a": "shipping", "b": "price"}):
        found = {n.attrs["itemprop"]: selectors.similarity(n, fp, spec) for n in dom.parse(page.format(**order)).walk() if "itemprop" in n.attrs}
        assert found["price"] == pytest.approx(found["shipping"] + 2 / 14.5)
    moved = selectors.relocate([page.format(a="shipping", b="price")] * 2, fp, spec, [12.0, 12.0])
    assert moved and [n.text() for n in selectors.select(dom.parse(page.format(a="shipping", b="price")), moved["expr"])][:1] == ["12.00"]


def test_links_are_made_once(spark):
    """The canonical form of a link stands in the plan once, not in each filter that names it."""
    pages = spark.createDataFrame([(1, "http://a.com/x", "<a href='/y?b=1'>y</a> <a href='z.pdf'>z</a> <a href='http://b.com/'>b</a>")], "page_id long, url string, html string")
    links = frontier.page_links(pages)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") < 300
    assert [(r.page_id, r.link) for r in links.collect()] == [(1, "http://a.com/y?b=1")]


def test_compared_records_keep_their_tasks(spark):
    prev, cur = (spark.range(100).selectExpr("id", f"id % {n} AS q") for n in (7, 8))
    kinds = recdiff.row_kinds(prev, cur, "id", tasks=9)
    assert kinds.rdd.getNumPartitions() == 9
    assert kinds.count() == sum(i % 7 != i % 8 for i in range(100))
    assert recdiff.tasks_for(prev) >= 8 * prev.rdd.getNumPartitions()
