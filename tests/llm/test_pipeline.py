"""The pipeline's stages on the smallest tables, each against a plain version on its own input."""

import os
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from pyspark.sql import functions as F  # noqa: E402

from loomspark.llm import mixing, packing, secrets, toxicity  # noqa: E402
from loomspark.llm.common import materialize  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input, output) of every stage, each written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = materialize(stage(spark, docs, SF))
        out[name] = (docs, made)
        docs = made
    return out


def keyed(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    names = list(stages)
    assert names == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    first = stages["toxicity"][0].schema
    for name in names[:-1]:
        assert [(f.name, f.dataType) for f in stages[name][1].schema] == [(f.name, f.dataType) for f in first]


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    judged = {r.doc_id: r.predicted for r in toxicity.toxicity(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(keyed(after)) == {d for d, p in judged.items() if not p}
    assert all(keyed(before)[d] == r for d, r in keyed(after).items())


def test_near_duplicates(stages):
    """All pairs of texts, by their whole sets of five-word shingles."""
    before, after = stages["near_duplicates"]
    rows = keyed(before)
    sets = {}
    for d, r in rows.items():
        words = r.text.encode().lower().split()
        sets[d] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    label = {d: d for d in rows}
    for d in sorted(rows):
        for e in sorted(rows):
            if e < d and 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e]):
                a, b = sorted((label[d], label[e]))
                label = {k: a if v == b else v for k, v in label.items()}
    kept = sorted(set(label.values()))
    assert sorted(keyed(after)) == kept and all(rows[d] == r for d, r in keyed(after).items())


def test_secrets(stages):
    before, after = stages["secrets"]
    rows, found = keyed(before), {}
    for r in secrets.findings(before).where("is_secret = 1").collect():
        found.setdefault(r.doc_id, []).append((r.start, r.length))
    for d, r in keyed(after).items():
        text = rows[d].text
        for start, length in sorted(found.get(d, []), reverse=True):
            text = text[:start] + secrets.MARK + text[start + length :]
        assert r.text == text and r.n_chars == (rows[d].n_chars if text == rows[d].text else len(text))
    assert set(keyed(after)) == set(rows)
    known = re.compile(r"\bAKIA[0-9A-Z]{16}\b|password=[0-9a-f]{18}\b")
    assert not any(known.search(r.text) for r in after.collect())


def test_mixing(stages):
    before, after = stages["mixing"]
    taken = {r.doc_id: r.taken // r.size for r in mixing.mixing_report(before).collect() if r.taken}
    got = {}
    for r in after.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert r == keyed(before)[r.doc_id]
    assert got == taken
    order = {r.doc_id: r.positions for r in mixing.mixing_report(before).collect()}
    stream = [r.doc_id for r in after.orderBy("_metadata.file_name", "_metadata.row_index").collect()]
    assert stream == [d for _, d in sorted((u, d) for d, own in order.items() for u in own)]


def test_packing(spark, stages, vocabulary):
    before, after = stages["packing"]
    want = packing.pieces(before, vocabulary).groupBy("doc_id", "piece", "ids_crc32").count()
    assert sorted(want.collect()) == sorted(after.groupBy("doc_id", "piece", "ids_crc32").count().collect())
    full = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count_distinct("offset").alias("d"), F.count("*").alias("c"))
    assert full.where("n > 4096 OR d <> c").count() == 0
    # A task's sequences hold one stretch of the training order.
    spans = after.groupBy(F.shiftright("sequence_id", 40).alias("task")).agg(F.min(F.struct("order_0", "order_1")).alias("a"), F.max(F.struct("order_0", "order_1")).alias("b"))
    ends = [(tuple(r.a), tuple(r.b)) for r in spans.orderBy("task").collect()]
    assert all(x[1] < y[0] for x, y in zip(ends, ends[1:], strict=False))


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(got.select("doc_id", "piece", "length", "ids_crc32").collect()) == sorted(stages["packing"][1].select("doc_id", "piece", "length", "ids_crc32").collect())
