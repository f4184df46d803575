"""Conversation repair against all edit sequences, and long conversations against short ones."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from loomspark.llm import turns
from loomspark.llm.queries import QUERIES, SQL

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def brute(symbols):
    """All edit sequences with up to two inserts between rows, over rows of (initial, fault)."""
    best = None
    places = [["", "I", "II"]] * (len(symbols) + 1)
    for inserts in itertools.product(*places):
        for ops in itertools.product("KRD", repeat=len(symbols)):
            if any(f in "bd" and o != "D" for (_, f), o in zip(symbols, ops)):
                continue
            cost = 2 * sum(map(len, inserts)) + sum({"K": 0, "R": 2, "D": 3}[o] + (f == "t" and o != "D") for (_, f), o in zip(symbols, ops))
            free = []  # the initial of each turn that stays, or both roles
            for ins, (o, (i, _)) in itertools.zip_longest(inserts, zip(ops, symbols), fillvalue=("D", ("", ""))):
                free += ["ua"] * len(ins) + ([i] if o == "K" else ["ua"] if o == "R" else [])
            if not re.fullmatch("(s?([ux][ax])*)?", "".join("x" if f == "ua" else f or "?" for f in free)) or free == ["s"]:
                continue
            audit = "".join(ins + o for ins, o in zip(inserts, [*ops, ""]))
            best = min(best or (cost, audit), (cost, audit))
    return best


def plain(rows):
    """The contract in plain Python over (conv_id, turn, role, text), with the brute-force edits for few rows, else the operator's."""
    convs = {}
    for c, t, r, x in rows:
        kept = convs.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        hit = zlib.crc32(":".join(" " if v is None else str(v) for v in (c, t)).encode()) % 20
        x = "" if hit == 1 else re.sub("[.!?]", "", x) if hit == 2 else x
        kept += [(t, "user" if hit == 4 else r, x)] * {0: 0, 3: 2}.get(hit, 1)
    out = []
    for c, kept in convs.items():
        kept.sort(key=lambda k: (k[0] is not None, k[0] or 0, k[1].encode(), k[2].encode()))
        seen, symbols = set(), []
        for _, r, x in kept:
            words = re.findall(r"[^\x20\x09-\x0D]", x)
            symbols.append((r[:1], "b" if not words else "d" if (r, x) in seen else "t" if words[-1] not in ".!?" else "."))
            seen.add((r, x))
        cost, audit = brute(symbols) if len(symbols) < 4 else turns.cheapest("".join((i if i in tuple("sua") else "?") + f for i, f in symbols))
        lines, at = [], 0
        for label in audit:
            role, text = kept[at][1:] if label != "I" else (None, "")
            at += label != "I"
            if label == "D":
                continue
            if label != "K":
                role = "user" if not lines or lines[-1][0] in "as" else "assistant"
            lines.append(f"{role}:{text}")
        known = [t for t, *_ in kept if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
        faults = [f for _, f in symbols]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((c, gaps, *(faults.count(f) for f in "bdt"), pairs, cost, audit, digest))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_cheapest_equals_all_edit_sequences():
    kinds = list(itertools.product("sua?", ".bt"))
    for n in range(3):
        for symbols in itertools.product(kinds, repeat=n):
            assert turns.cheapest("".join(map("".join, symbols))) == brute(symbols)
    rng = random.Random(5)
    for _ in range(10):
        symbols = [rng.choice(kinds) for _ in range(4)]
        assert turns.cheapest("".join(map("".join, symbols))) == brute(symbols)


def test_stretches_compose():
    rng = random.Random(6)
    for _ in range(200):
        symbols = "".join(rng.choice("sua?") + rng.choice("..dbt") for _ in range(40))
        cut = 2 * rng.randrange(41)
        joined = turns.times({0: (0, "")}, {0: turns.stretch(symbols[:cut])})
        joined = turns.times(joined, {s: turns.stretch(symbols[cut:], s) for s in joined})
        assert turns.finished(joined) == turns.cheapest(symbols)
    long = "".join(rng.choice("sua?") + rng.choice("..dbt") for _ in range(3000))
    assert turns.cheapest(long) == turns.finished(turns.stretch(long))


def made(seed, convs=60, rows=9):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Yes.", "No", "", " \t", None, "What?", "Well!  ", "Ünï.", "a\nb", "\u00a0"]
    weights = [8, 8, 2, 1, 1, 1, 1]
    out = []
    for c in range(convs):
        for t in range(rng.randrange(1, rows)):
            out.append((None if c == 7 else c, rng.choice([None, t, t, t, t + 5]), rng.choices(roles, weights)[0], rng.choice(texts)))
    return out


@pytest.mark.parametrize("limits", [{}, {"long_rows": 3}, {"long_rows": 0}, {"long_bytes": 12}])
def test_repair_equals_the_plain_contract(spark, limits):
    rows = made(1) + [(3, 1, "user", "x" * 100_000 + ".")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(turns.repair(turns.damage(df), **limits)) == plain(rows)


def test_blocks_and_whole_conversations_agree(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", "", f"Text {rng.randrange(40)}."])) for c in (1, 2) for t in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(turns, "BLOCK", 16)
    blocks = turns.repair(df, long_rows=10)
    whole = turns.repair(df)
    assert got(blocks) == got(whole)
    split = turns.repaired_turns(df, long_rows=10).orderBy("conv_id", "position").drop("position").collect()
    assert split == turns.repaired_turns(df).orderBy("conv_id", "position").drop("position").collect()
    text = "\n".join(f"{r.role}:{r.text}" for r in split if r.conv_id == 1)
    assert hashlib.sha256(text.encode()).hexdigest() == got(whole)[0][-1]


def test_dropped_conversations_other_columns_and_empty_tables(spark):
    dropped = [c for c in range(2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    rows = [(c, 0, "user", "Yes.", "k", 1) for c in dropped]
    df = spark.createDataFrame(rows, SCHEMA + ", key string, n int")
    empty = hashlib.sha256(b"").hexdigest()
    for limits in ({}, {"long_rows": -1}):
        assert got(turns.repair(turns.damage(df), **limits)) == sorted([(c, 0, 0, 0, 0, 0, 0, "", empty) for c in dropped], key=repr)
        assert got(turns.repair(turns.damage(df.limit(0)), **limits)) == []


def test_extreme_turns(spark):
    rows = [(1, -(2**63), "user", "A."), (1, 2**63 - 1, "assistant", "B.")]
    for limits in ({}, {"long_rows": 1}):
        assert got(turns.repair(spark.createDataFrame(rows, SCHEMA), **limits))[0][1] == 2**63 - 1


def test_sql_over_odd_rows(spark, tmp_path):
    """The registered SQL, on rows without ties in a turn, which it leaves open."""
    rows = list({(r[0], r[1]): r for r in made(3)}.values())
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    table = con.execute(SQL["op12_conversation_repair"]).to_arrow_table().select(COLUMNS).to_pylist()
    assert sorted((tuple(r.values()) for r in table), key=repr) == got(QUERIES["op12_conversation_repair"](spark, str(tmp_path)))
