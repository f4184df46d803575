import pytest
from pyspark.sql import functions as F

from loomspark.functions import classify, hosting
from loomspark.operators import dom, evidence, frontier, research, selectors


def test_options():
    o = research.Options(1.0, "openai", allow=("https://www.b.com/x", "a.com", "B.com"))
    made = o.normalized(["openai", "ollama"])
    assert made.max_tool_calls == 40 and made.allow == ("a.com", "b.com") and o.allow[0].startswith("https")
    bad = [{"provider": ""}, {"effort": "huge"}, {"max_cost_usd": float("nan")}, {"max_cost_usd": 0.0}, {"max_tool_calls": -1}, {"judge_provider": "openai"}, {"deny": ("nodots",)}, {"published_from": "2024-02-01", "published_to": "2024-01-01"}]
    for change in bad:
        with pytest.raises(research.OptionError) as e:
            research.Options(**{"max_cost_usd": 1.0, "provider": "openai", **change}).normalized(["openai"])
        assert e.value.option == next(iter(change))


def test_plan_and_control(spark):
    rows = [("r", 1, " one \n question", [" a ", ""]), ("r", 2, " ", ["b"]), ("r", 3, "three", None), ("r", 4, "four", ["d"]), ("s", 1, None, ["x"])]
    angles = spark.createDataFrame(rows, "run_id string, position int, question string, queries array<string>")
    assert sorted(map(tuple, research.tidy_plan(angles, 2).collect())) == [("r", 1, "one question", ["a"]), ("r", 2, "three", ["three"])]
    messages = spark.createDataFrame([(1, 1, None, False), (1, 2, " go on ", False), (1, 3, " ", True), (1, 4, "stop", False), (2, 1, "", None)], "run int, n int, steer string, write_now boolean")
    got = {(r.run, r.n): (r.steer, r.write_now) for r in research.control(messages, "run", ["n"]).collect()}
    assert got == {(1, 1): ("", False), (1, 2): ("go on", False), (1, 3): ("go on", True), (1, 4): ("stop", True), (2, 1): ("", False)}


def test_governor(spark):
    budget = research.Governor(1.0)
    assert budget.ask("a", "research", 0.5) and not budget.ask("b", "research", 0.4) and budget.ask("b", "write", 0.4)
    budget.logged("a", 0.1)
    budget.logged("a", 0.0)
    assert budget.spent == 0.1 and budget.ask("c", "research", 0.35) and not budget.ask("d", "research", 0.01)
    budget.write_now = True
    assert not budget.ask("e", "research", 0.0, True) and budget.ask("f", "finish", 0.0) and not budget.boundary() and not budget.tool()
    events = [("r", 1, "ask", "a", "research", 0.8, False), ("r", 2, "ask", "b", "research", 0.1, False), ("r", 3, "logged", "a", "", 0.2, False), ("r", 4, "ask", "b", "research", 0.1, False), ("r", 5, "write_now", "", "", 0.0, False), ("r", 6, "ask", "c", "research", 0.0, True), ("r", 7, "ask", "c", "write", 0.5, False), ("s", 1, "tool", "", "", 0.0, False), ("s", 2, "tool", "", "", 0.0, False)]
    df = spark.createDataFrame(events, "run_id string, seq int, event string, call string, kind string, usd double, flat boolean")
    got = {(r.run_id, r.seq): r.admitted for r in research.govern(df, 1.0, tools=1).collect()}
    assert [got["r", n] for n in range(1, 8)] == [True, False, True, True, True, False, True] and [got["s", n] for n in (1, 2)] == [True, False]


def test_research_loop(spark):
    plan = research.tidy_plan(spark.createDataFrame([("r", 1, "q1", ["a", "b"]), ("r", 2, "q2", ["c", "A"])], "run_id string, position int, question string, queries array<string>"), 5)
    asked = []

    def search(now):
        asked.append(sorted(r.query for r in now.collect()))
        hits = F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(F.concat("query", i.cast("string")).alias("url"), i.alias("rank"))))
        return now.select("run_id", "angle", hits.alias("h")).select("run_id", "angle", "h.url", "h.rank")

    read = lambda hits: hits.select("run_id", "angle", "url", F.upper("url").alias("quote"))
    replan = lambda facts: facts.limit(1).select("run_id", F.lit(1).alias("angle"), F.lit("gap").alias("query"), F.lit("gap").alias("kind"), F.lit(9).alias("asked"))
    facts = research.research(plan, search, read, replan, research.Options(1.0, "x"), lambda: True)
    assert asked == [["a", "c"], ["gap"], ["b"]] and facts.count() == 12
    assert research.research(plan, search, read, replan, research.Options(1.0, "x"), lambda: False).count() == 0


def test_facts_by_quote(spark):
    schema = "fact_id string, url string, quote string"
    before = spark.createDataFrame([("f1", "u", "The  Quote — here"), ("f2", "u", "the quote - here"), ("f3", "u", "gone"), ("f4", None, "x")], schema)
    after = spark.createDataFrame([("g1", "u", "the quote – HERE"), ("g2", "v", "gone"), ("g3", None, "x")], schema)
    got = sorted(((r.url, r.old_id, r.new_id) for r in evidence.match_facts(before, after).collect()), key=repr)
    assert got == sorted([("u", "f1", "g1"), ("u", "f3", None), ("v", None, "g2"), (None, "f4", None), (None, None, "g3")], key=repr)


OLD, NEW = '<div class=card><b class=name>{n}</b><span class="price">{p}</span></div>', '<div class=box><b class=name>{n}</b><section><em class="price big">{p}</em></section></div>'


def test_healing(spark):
    document = {"name": {"type": "css", "expr": ".name"}, "price": {"type": "css", "expr": ".price-old", "coerce": "float"}, "c": {"type": "css", "expr": ".c"}}
    samples = [{"html": NEW.format(n=f"N{i}", p=f"{i}.50"), "truth": {"name": f"N{i}", "price": i + 0.5}} for i in (1, 2, 3)]
    moved = selectors.heal(document, ["price"], samples, {"price": selectors.fingerprint(dom.first(dom.parse(OLD.format(n="N", p="9.90")), ".price"))})
    assert moved["name"] == document["name"] and [selectors.apply_document(s["html"], moved)[0]["price"] for s in samples] == [1.5, 2.5, 3.5]
    learned = selectors.heal(document, ["price"], samples, {}, {"price": {"coerce": "float"}})
    assert learned["name"] == document["name"] and selectors.apply_document(samples[0]["html"], learned)[0]["price"] == 1.5
    assert selectors.heal(document, ["price"], [], {}) == document and selectors.full_redesign(4, 2) and not selectors.full_redesign(5, 2) and not selectors.full_redesign(0, 0)
    import json

    triggers = spark.createDataFrame([("d", "price"), ("d", "price")], "domain string, field string")
    documents = spark.createDataFrame([("d", json.dumps(document), None), ("e", "{}", None)], "domain string, fields string, fingerprints string")
    rows = spark.createDataFrame([("d", i, s["html"], json.dumps(s["truth"])) for i, s in enumerate(samples)], "domain string, seq int, html string, truth string")
    healed = selectors.heal_domains(triggers, documents, rows, {"price": {"coerce": "float"}}).collect()
    assert [(r.domain, r.healed) for r in healed] == [("d", ["price"])]


def test_harvest(spark):
    page = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    pages = spark.createDataFrame([("http://a.com/", page("/1", "/2", "http://b.com/")), ("http://a.com/1", page("/3")), ("http://a.com/2", ""), ("http://a.com/3", ""), ("http://b.com/", "")], "url string, html string")
    got = frontier.harvest(pages, spark.createDataFrame([("a.com", "http://a.com/")], "domain string, url string"))
    assert sorted((r.url, r.depth) for r in got.collect()) == [("http://a.com/", 0), ("http://a.com/1", 1), ("http://a.com/2", 1)]


def test_hosting(spark):
    def one(make, values, kind="string"):
        df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
        return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]

    assert one(hosting.is_free_model, ["Ollama/x", "llama3", "a:FREE", "gpt"]) == [True, True, True, False]
    assert one(hosting.needs_key, ["", None, "OLLAMA", "codex", "openai", "typo"]) == [False, False, False, False, True, True]
    assert one(hosting.exit_code, [None, "", "robots", "odd", "options"]) == [0, 0, 5, 1, 2]
    assert one(hosting.error_message, ["é" * 1500])[0] == "é" * 1000
    waits = one(lambda a: hosting.retry_wait(a, F.lit(500), F.lit(None).cast("int"), F.lit("s")), [1, 2, 3, 4], "int")
    assert waits[3] is None and all(0.5 * w <= x <= 1.5 * w for w, x in zip((0.5, 1, 2), waits[:3], strict=True))
    assert one(lambda s: hosting.retry_wait(F.lit(1), s, F.lit(7), F.lit("s")), [429, 404, 200, 503], "int") == [7.0, None, None, 7.0]
    assert one(lambda s: F.size(hosting.retries_in_time(F.array(F.lit(60.0), s, F.lit(1.0)))), [50.0, 70.0], "double") == [3, 1]
    assert len(set(one(hosting.session_token, ["A.com", "a.com", "b.com"]))) == 2
    assert hosting.choose_proxy(["a", "b", "c"], [9.0, 0.0, 0.0], 5.0, "h", 1, False) == 2 and hosting.choose_proxy(["a", "b"], [0.0, 0.0], 1.0, "h", 5, True) == hosting.choose_proxy(["a", "b"], [0.0, 0.0], 1.0, "H", 6, True)
    with pytest.raises(ValueError):
        hosting.choose_proxy(["a"], [9.0], 5.0, "h", 0, True)
    good = [("3", "int", 3), (3.0, "int", 3), ("true", "bool", True), ("TRUE", "bool", True), ('["a"]', "list", ["a"]), ("a, b", "list", ["a", "b"]), ('{"a":1}', "map", {"a": 1}), (None, "int", None)]
    assert all(hosting.flexible(v, k) == w for v, k, w in good)
    for v, k in (("3.7", "int"), (3.7, "int"), ("maybe", "bool"), (True, "int"), ("x", "map")):
        with pytest.raises(ValueError):
            hosting.flexible(v, k)
    assert len(hosting.run_id()) == 32


def test_flat_rates_and_free_models_cost_nothing(spark):
    rows = spark.createDataFrame([("gpt-4o-mini", "openai"), ("gpt-4o-mini", "codex"), ("llama3", None), ("odd", None)], "m string, p string")
    usd = [r.x for r in rows.select(classify.cost(F.col("m"), F.lit(1_000_000), F.lit(1_000_000), True, F.col("p")).alias("x")).collect()]
    assert usd == pytest.approx([0.75, 0.0, 0.0, 12.0])


def test_few_bytes_of_many_runs_are_dealt_to_all_tasks(spark):
    rows = [(f"r{i % 200}", i, "ask", str(i), "research", 0.3, False) for i in range(800)]
    events = spark.createDataFrame(rows, "run_id string, seq long, event string, call string, kind string, usd double, flat boolean").coalesce(1)
    told = research.govern(events, 1.0)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert told.rdd.getNumPartitions() == tasks
    got = [(r.run_id, r.admitted) for r in told.orderBy("run_id", "seq").collect()]
    assert all([a for _, a in got[i : i + 4]] == [True, True, False, False] for i in range(0, 800, 4))
