"""Records of JSON files against a plain decoder, however the files are cut."""

import json
import random

import pytest

from loomspark.sources import records


def value(rng, depth=0):
    kind = rng.randrange(4 if depth > 3 else 6)
    if kind == 0:
        return rng.choice([None, True, False])
    if kind == 1:
        return rng.choice([0, -1, 1.5, 12345678901234567890, 1e300])
    if kind < 4:
        return "".join(rng.choices(['"', "\\", "[", "]", "{", "}", ",", ":", "\n", "a", "é", " ", "\u2028"], k=rng.randrange(12)))
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}{value(rng, 4) if i else ''}"[:9]: value(rng, depth + 1) for i in range(rng.randrange(4))}


def document(rng, n):
    """A text of n top-level values in different writings, and its records."""
    texts, found = [], []
    for _ in range(n):
        v = value(rng)
        found += v if isinstance(v, list) else [v]
        texts.append(json.dumps(v, indent=rng.choice([None, None, 1]), ensure_ascii=rng.random() < 0.5, separators=rng.choice([(",", ":"), (", ", ": "), (" ,\n", " : ")])))
    return rng.choice(["\n", " \n\n", "\r\n"]).join(texts), found


def cut_in_python(parts, separator):
    stack, inside, whole, crossing = "", False, [], []
    for part in parts:
        cutter = records.Cutter(stack, inside, separator)
        for kind, text in [*cutter.feed(part), *cutter.rest()]:
            if kind == 0:
                whole.append(text)
            else:
                crossing = ([] if kind == 2 else crossing) + [text]
                if kind == 1:
                    whole.append("".join(crossing))
        summed = records.Summary()
        summed.feed(part)
        stack, inside = records.without_pairs(stack + summed.brackets[inside]), summed.inside[inside]
    return whole, stack, inside


@pytest.mark.parametrize("separator", records.SEPARATORS)
def test_any_cut_gives_the_same_records(separator):
    for seed in range(300):
        rng = random.Random(seed)
        text, found = document(rng, rng.randrange(6))
        pieces = text.split(separator)
        cuts = sorted(rng.sample(range(len(pieces) + 1), min(len(pieces), rng.randrange(5))))
        parts = [separator.join(p) + separator for a, b in zip([0, *cuts], [*cuts, len(pieces)]) if (p := pieces[a:b])]
        got, stack, inside = cut_in_python(parts, separator)
        assert list(map(json.loads, got)) == found and not stack and not inside, (seed, text)


def read(spark, path):
    return records.read_records(spark, str(path)).orderBy("file", "start", "number").collect()


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_one_line_lines_and_pretty_files_in_many_tasks(spark, small_splits, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "PIECE", 1000)
    rng = random.Random(1)
    found = [{"n": i, "v": value(rng)} for i in range(4000)]
    found[7]["v"] = "x" * 60_000  # longer than a split
    writings = {
        "line": json.dumps(found),
        "lines": "".join(json.dumps(r) + "\n" for r in found),
        "odd": "[" + ",\n".join(json.dumps(r, indent=1 if i == 1500 else None) for i, r in enumerate(found)) + "]",
        "bare": "".join(json.dumps(r["n"]) + " " for r in found),
    }
    for name, text in writings.items():
        (tmp_path / f"{name}.json").write_text(text)
        got = read(spark, tmp_path / f"{name}.json")
        assert all(r.error is None for r in got)
        assert [json.loads(r.record) for r in got] == ([r["n"] for r in found] if name == "bare" else found)
        if name != "bare":
            assert len({r.start for r in got}) > 5
    assert len(read(spark, tmp_path / "*.json")) == 4 * len(found)
    text = records._pieces(spark, str(tmp_path / "line.json"), ",")
    assert text.rdd.getNumPartitions() >= len(writings["line"]) // 20000


def test_faults_are_rows(spark, small_splits, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "PIECE", 1000)
    good = [json.dumps({"n": i, "t": "y" * 100}) for i in range(1000)]
    cases = {
        "open.json": ("[" + ",".join(good), 1000, "brackets or strings do not end"),
        "string.json": ("\n".join(good) + '\n{"a": "b', 1000, "brackets or strings do not end"),
        "closed.json": ("\n".join(good[:500]) + "\n}\n" + "\n".join(good[500:]), 500, "brackets or strings do not end"),
        "word.json": ("\n".join(good) + "\nnope\n{'a': 1}", 1000, "no JSON value"),
        "empty.json": ("", 0, None),
        "blank.json": (" \n\n ", 0, None),
        "bytes.json": (b'{"a": "\xff\xfe"}', 1, None),
    }
    for name, (text, n, error) in cases.items():
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
        got = read(spark, tmp_path / name)
        assert sum(r.record is not None for r in got) == n, name
        assert {r.error for r in got if r.record is None} == ({error} if error else set()), name


def test_many_splits_are_joined_by_a_shuffle(spark, small_splits, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "PIECE", 1000)
    monkeypatch.setattr(records, "TOLD", 0)
    found = [{"n": i, "t": ["z" * 50]} for i in range(2000)]
    (tmp_path / "a.json").write_text(json.dumps(found))
    assert [json.loads(r.record) for r in read(spark, tmp_path / "a.json")] == found


def test_a_file_on_one_line_is_not_read_as_one_row(spark, tmp_path, monkeypatch):
    """The separators that leave a long piece are known before Python gets any; a folder's other files do not hide it."""
    monkeypatch.setattr(records, "PIECE", 1000)
    (tmp_path / "a.json").write_text("[" + ",".join(f'{{"a":{i}}}' for i in range(2000)) + "]")
    (tmp_path / "b.json").write_text("[1,2]\n")
    tried = []
    real = records.summaries
    monkeypatch.setattr(records, "summaries", lambda pieces, separator: (tried.append(separator), real(pieces, separator))[1])
    assert records.read_records(spark, f"{tmp_path}").count() == 2002
    assert tried == [","]
