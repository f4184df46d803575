import pytest
from pyspark.sql import functions as F

from loomspark.functions import classify, coerce, jsonfns, text, urls


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def canonical_cases():
    """Addresses and their canonical forms, put together from parts by the rules: scheme and host in lower case, own ports and
    fragments gone, a path at least, tracking keys gone, the rest sorted by key."""
    for scheme, port in (("http", 80), ("https", 443)):
        for tracked in ("gclid", "fbclid", "msclkid", "utm_medium", "UTM_Id"):
            for kept, sorted_ in (((), ""), (("n=4", "k=3"), "?k=3&n=4"), (("k=9", "k=8"), "?k=9&k=8")):
                query = "&".join([*kept[:1], f"{tracked}=v", *kept[1:]])
                yield f" {scheme.upper()}://Shop.Example:{port}/Items/7?{query}#part ", f"{scheme}://shop.example/Items/7{sorted_}"
        yield f"{scheme}://shop.example:{523 - port}", f"{scheme}://shop.example:{523 - port}/"
    yield from ((None, None), ("no address", None), ("https://?q=1", None), ("file:///srv/a", "file:///srv/a"), ("http://shop.example/?q=x%20~*", "http://shop.example/?q=x+~%2A"), ("http://shop.example/?flag", "http://shop.example/?flag="))


URLS = dict(canonical_cases())


def test_canonical_urls(spark):
    assert column(spark, list(URLS), urls.canonicalize) == list(URLS.values())
    again = [u for u in URLS.values() if u]
    assert column(spark, again, urls.canonicalize) == again


def test_hosts_scopes_and_globs(spark):
    assert column(spark, ["http://A.b.co.uk:81/x", "file:///x", "nothing"], urls.domain) == ["a.b.co.uk", "file", "invalid"]
    hosts = ["a.b.co.uk", "www.x.com", "localhost", "10.0.0.1", "y.github.io"]
    assert column(spark, hosts, urls.registrable_domain) == ["b.co.uk", "x.com", "localhost", "10.0.0.1", "y.github.io"]
    scope = urls.Scope("ex.com", True, "/docs", ["/docs/**"], ["/docs/*.pdf"])
    tried = ["http://ex.com/docs/a", "http://sub.ex.com/docs/a/b", "http://notex.com/docs/a", "http://ex.com.evil.com/docs/a", "http://ex.com/docs/a.pdf", "http://ex.com/other"]
    assert column(spark, tried, scope.allows) == [True, True, False, False, False, False]
    assert column(spark, ["notnature.com", "nature.com", "www.nature.com", "a.nature.com", "nature.com.evil.com"], lambda c: urls.policy_match(c, ["nature.com"])) == [False, True, True, True, False]
    assert column(spark, ["http://x/a.PDF?y=.html", "http://x/a.html?b=.png", "http://x/"], urls.is_asset) == [True, False, False]
    assert urls.normalize_domain(" https://*.Example.com:80/x ") == "example.com"
    for bad in ("localhost", ""):
        with pytest.raises(ValueError):
            urls.normalize_domain(bad)
    for bad in ("*" * 2000, "**/**/**/**/**"):
        with pytest.raises(ValueError):
            urls.Scope(include=[bad])


def test_text(spark):
    words = ["", "# Hi\n\n**bold** and [link](http://x) here", "```\none line\n```", "![alt](x.png) a", None]
    assert column(spark, words, text.markdown_words) == [0, 5, 2, 1, None]
    assert column(spark, [" a\t\nb c "], text.collapse) == ["a b c"]
    assert column(spark, ["=1+1", "-5", "@x", "a", "-5.5e3", "+x"], text.csv_cell) == ["'=1+1", "-5", "'@x", "a", "-5.5e3", "'+x"]
    assert column(spark, ["a b c d", "a b"], lambda c: text.cap_words(c, 3)) == ["a b c", "a b"]
    assert column(spark, ["One. Two! Three? Four.", "None"], lambda c: text.cap_sentences(c, 2)) == ["One. Two!", "None"]
    assert column(spark, ["#FFF #a1b2c3 #12345 #FfF"], text.hex_colors) == [["#a1b2c3", "#fff"]]
    assert column(spark, ["socks5://u:p@h:9/x", "h:1"], text.redact_proxy) == ["h:9", "h:1"]
    assert column(spark, ["$1,299.00", "12%", "x1"], text.is_numeric_text) == [True, True, False]


def test_coercions(spark):
    assert column(spark, ["42", " 3,9 ", "-7.2", "x", None], coerce.to_int) == [42, 3, -7, None, None]
    assert column(spark, ["1,5", "2.5e2", "1.2.3"], coerce.to_float) == [1.5, 250.0, None]
    assert column(spark, ["€ 1 299,50", "12'000"], coerce.to_eur) == [1299.5, 12000.0]
    assert column(spark, ["Ja", "NON", "perhaps"], coerce.to_bool) == [True, False, None]
    dates = ["12.03.2024", "2024-02-30", "03/04/2024", "12/31/2024", "1.2.2024", "March 5, 2024", "7 Jan 2024", "am 9.8.2023 um", "2024-05-06T07:08:09Z", "soon"]
    assert column(spark, dates, coerce.to_iso_date) == ["2024-03-12", None, "2024-04-03", "2024-12-31", "2024-02-01", "2024-03-05", "2024-01-07", "2023-08-09", "2024-05-06", None]
    assert column(spark, ["price 12,99 EUR", "none"], lambda c: coerce.by_regex(c, r"[0-9]+[.,][0-9]{2}")) == ["12,99", None]
    assert column(spark, ["1.2k views", "3M", "1,234", "•"], coerce.count_with_suffix) == [1200, 3000000, 1234, None]
    assert column(spark, ["a 12,99 b"], lambda c: coerce.apply_hints(c, regex=r"(\d+,\d+)", coerce="float")) == [12.99]
    with pytest.raises(ValueError):
        coerce.apply_hints(F.lit("x"), coerce="nonsense")


def test_json(spark):
    assert column(spark, ['{"offers":{"price":"49.99"}}', "[]", "broken"], lambda c: jsonfns.path(c, "$.offers.price")) == ["49.99", None, None]
    assert column(spark, ['[{"x":1},{"a":{"b":2}}]'], lambda c: jsonfns.blocks(c, "$.a.b", "int")) == [2]
    leaves = jsonfns.leaves('{"b": {"c": 9007199254749936, "d": 19.90}, "a": "  x\\n y ", "e": null, "f": [1.0, "z"], "g": true, "h": {}}')
    assert leaves == [("a", "s", "x y", False), ("b.c", "n", "9007199254749936", False), ("b.d", "n", "19.9", False), ("e", "z", "null", False), ("f", "a", '[1.0,"z"]', False), ("g", "t", "true", False), ("h", "a", "{}", False)]
    assert jsonfns.leaves("no") == [] and jsonfns.leaves("[1]") == []


def test_quality_rules(spark):
    rich = " ".join(["word"] * 300)
    cases = [
        ("Blocked\nJust a moment.", "", 403, "akamai", "access-denied"), ("Sign in", "", 401, "", "login-required"), ("x", "", 503, "", "unavailable"), ("x", "", 429, "", "unavailable"),
        ("App\nLoading.", "", 200, " ".join(["body"] * 20), "empty"), (rich, "", 200, "captcha", ""), (rich, "", 403, "just a moment", ""), ("x", "", 404, "", "empty"), (" ".join(["w"] * 40), "", 200, "", ""),
        ("stub", "", 200, "captcha", "empty"), ("please wait", "", 200, "<title>Just a moment", "access-denied"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, md string, title string, status int, body string, want string")
    got = df.select("i", "want", classify.quality(F.col("md"), F.col("title"), F.col("status"), F.col("body")).alias("issue")).orderBy("i").collect()
    assert [(r.i, r.issue) for r in got] == [(r.i, r.want) for r in got]


def test_costs_and_retries(spark):
    df = spark.createDataFrame([("gpt-4o-mini", 1000000, 1000000), ("unknown", 1, 1), ("x:free", 10, 10)], "m string, p long, c long")
    assert [round(r.u, 6) for r in df.select(classify.cost(F.col("m"), F.col("p"), F.col("c")).alias("u")).collect()] == [0.75, 0.0, 0.0]
    assert column(spark, [200, 404, 429, 500, 302], classify.retry_class, "int") == ["ok", "permanent", "retry", "retry", "permanent"]
    assert column(spark, ["7", "soon", None], classify.retry_after) == [7, None, None]
