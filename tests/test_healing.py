"""A stream whose template changes midway: nulls between, none after, and a restart that repeats nothing."""

import json

from loomspark.operators import selectors
from loomspark.streaming.heal import PAGES, HealingStream, VersionedTable

OLD = "<html><body><h1>N{n}</h1><div class='box'><span class='price'>{n}.50</span></div></body></html>"
NEW = "<html><body><h1>N{n}</h1><div class='box'><p><b class='price now'>{n}.50</b></p></div></body></html>"


def write(spark, folder, batch, template, start, n=20, truth=True, domain="d"):
    rows = [(domain, start + i, template.format(n=start + i), json.dumps({"price": start + i + 0.5, "name": f"N{start + i}"}) if truth else None) for i in range(n)]
    spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(f"{folder}/pages")


def test_stream_heals_and_a_restart_repeats_nothing(spark, tmp_path):
    folder = str(tmp_path)
    document = {"price": {"type": "css", "expr": "span.price", "coerce": "float"}, "name": {"type": "css", "expr": "h1"}}
    prints = selectors.fingerprints(document, [OLD.format(n=1)])
    run = HealingStream(spark, folder)
    run.begin(spark.createDataFrame([("d", json.dumps(document), json.dumps(prints)), ("e", json.dumps(document), None)], "domain string, fields string, fingerprints string"))
    for batch, (template, start) in enumerate(((OLD, 0), (NEW, 100), (NEW, 200))):
        write(spark, folder, batch, template, start)
    write(spark, folder, 3, OLD, 300, 5, False, "e")
    source = lambda: spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/pages")

    def read(records):
        return sorted((r.seq, json.loads(r.record)["price"], r.since) for r in records.collect() if r.domain == "d")

    expected = [(i, i + 0.5, 0) for i in range(20)] + [(100 + i, None, 0) for i in range(20)] + [(200 + i, 200.5 + i, 2) for i in range(20)]
    assert read(run.run(source())) == expected
    assert all(json.loads(r.record)["name"] for r in spark.read.parquet(f"{folder}/records").collect())

    again = HealingStream(spark, folder)  # a new process with the same folder
    assert read(again.run(source())) == expected
    write(spark, folder, 4, NEW, 400)
    assert read(again.run(source())) == expected + [(400 + i, 400.5 + i, 2) for i in range(20)]

    # The last batch is run once more, as after a crash before its commit: the same rows, rings and selectors.
    tables = lambda: [sorted(map(repr, t.read(5).collect())) for t in (again.selectors, again.rings, again.samples)]
    before = tables()
    again.batch(spark.read.schema(PAGES).parquet(f"{folder}/pages").where("seq >= 400"), 4)
    assert tables() == before
    assert read(spark.read.schema("domain string, seq long, record string, nulls array<string>, since long").parquet(f"{folder}/records")) == expected + [(400 + i, 400.5 + i, 2) for i in range(20)]


def test_a_mended_fields_ring_begins_anew(spark, tmp_path):
    """Nulls left after a trigger came from the old selector; the first good page must not make a full ring of them."""
    folder = str(tmp_path)
    run = HealingStream(spark, folder)
    run.begin(spark.createDataFrame([("d", json.dumps({"price": {"type": "css", "expr": "span.price", "coerce": "float"}}), None)], "domain string, fields string, fingerprints string"))
    for batch, (template, start, n) in enumerate(((OLD, 0, 20), (NEW, 100, 18), (NEW, 200, 5), (NEW, 300, 5))):  # fires at the 9th null, nine more follow
        write(spark, folder, batch, template, start, n)
    records = run.run(spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/pages")).collect()
    assert {(r.seq // 100, r.since) for r in records} == {(0, 0), (1, 0), (2, 2), (3, 2)}
    assert [r.ring for r in run.rings.read(2).collect()] == [""]


def test_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(VersionedTable, "SNAPSHOT", 3)
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"], "v int, since long")
    for version in range(8):
        t.write(spark.createDataFrame([("a", version)] if version % 2 == 0 else [("b", version)], "k string, v int"), version)
    assert sorted(map(tuple, t.read(7).collect())) == [("a", 6, 6), ("b", 7, 7)]
    assert sorted(map(tuple, t.read(2).collect())) == [("a", 2, 2), ("b", 1, 1)]
    assert sorted(map(tuple, t.read(3).collect())) == [("a", 2, 2), ("b", 3, 3)]


def test_relocation_passes_over_unclear_pages_and_those_still_served():
    spec = {"type": "css", "expr": "span.price", "coerce": "float"}
    fp = selectors.fingerprints({"price": spec}, [OLD.format(n=1)])["price"]
    MOVED = OLD.replace("span", "em")  # noqa: N806
    unclear = "<html><body><p>nothing here</p></body></html>"
    pages = [MOVED.format(n=1), unclear, OLD.format(n=3), MOVED.format(n=4)]
    assert selectors.relocate(pages, fp, spec, [1.5, 2.5, 3.5, 4.5])["expr"] == ".price"
    assert selectors.relocate(pages[:3], fp, spec, [1.5, 2.5, 3.5]) is None  # one page does not do
    assert selectors.relocate([MOVED.format(n=i) for i in range(3)], fp, spec, [0.5, 1.5, 9.9])["expr"] == ".price"  # need(3) is 2
    assert selectors.relocate([MOVED.format(n=i) for i in range(3)], fp, spec, [0.5, 8.8, 9.9]) is None
