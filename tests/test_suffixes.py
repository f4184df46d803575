"""Public suffixes: the usual vectors, typed by hand, over a file of rules."""

from loomspark.operators import suffixes

RULES = """// ===BEGIN===
com
biz
uk.com

jp
ac.jp
kyoto.jp
ide.kyoto.jp
*.kobe.jp
!city.kobe.jp
*.ck
!www.ck
us
ak.us
k12.ak.us
cn   // with a remark
com.cn
公司.cn
*
"""
VECTORS = {
    "com": "com", "example.com": "example.com", "b.example.com": "example.com", "WwW.Example.COM.": "example.com", "example.example": "example.example", "a.b.example.example": "example.example",
    "uk.com": "uk.com", "a.b.example.uk.com": "example.uk.com", "jp": "jp", "test.jp": "test.jp", "ac.jp": "ac.jp", "www.test.ac.jp": "test.ac.jp", "kyoto.jp": "kyoto.jp", "b.ide.kyoto.jp": "b.ide.kyoto.jp",
    "a.b.ide.kyoto.jp": "b.ide.kyoto.jp", "c.kobe.jp": "c.kobe.jp", "b.c.kobe.jp": "b.c.kobe.jp", "a.b.c.kobe.jp": "b.c.kobe.jp", "city.kobe.jp": "city.kobe.jp", "www.city.kobe.jp": "city.kobe.jp",
    "ck": "ck", "test.ck": "test.ck", "a.b.test.ck": "b.test.ck", "www.ck": "www.ck", "www.www.ck": "www.ck", "test.k12.ak.us": "test.k12.ak.us", "www.test.k12.ak.us": "test.k12.ak.us", "www.test.ak.us": "test.ak.us",
    "食狮.com.cn": "xn--85x722f.com.cn", "www.食狮.公司.cn": "xn--85x722f.xn--55qx5d.cn", "shishi.xn--55qx5d.cn": "shishi.xn--55qx5d.cn", "1.2.3.4": "1.2.3.4", "[::1]": "[::1]", "localhost": "localhost", "a..com": "a..com", "": "",
}


def test_vectors(spark, tmp_path):
    (tmp_path / "rules.dat").write_text(RULES)
    rules = suffixes.suffix_rules(spark, str(tmp_path / "rules.dat"))
    assert rules.count() == 17
    hosts = spark.createDataFrame([(h,) for h in [*VECTORS, *VECTORS, None]], "name string")
    got = {r.host: r for r in suffixes.registrable(hosts, rules, "name").collect()}
    assert {h: r.domain for h, r in got.items()} == VECTORS
    assert got["a.b.test.ck"].suffix == "test.ck" and got["www.city.kobe.jp"].suffix == "kobe.jp" and got["b.example.com"].suffix == "com" and got["1.2.3.4"].suffix is None
    none = spark.createDataFrame([], "rule string")
    assert {r.host: r.domain for r in suffixes.registrable(hosts.where("name = 'a.b.c'").union(spark.createDataFrame([("x.co.uk",)], "name string")), none, "name").collect()} == {"x.co.uk": "co.uk"}
