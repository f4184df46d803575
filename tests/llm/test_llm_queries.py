"""The registered queries on the smallest tables: with SQL against DuckDB, the others for their shape."""

import os

import pytest

from loomspark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "op1": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op2": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op3": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op4": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op5": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "value": "string", "score": "double", "is_secret": "int"},
    "op6": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op7": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op9": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op10": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op11": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op12": {
        "conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string",
    },
    "op13": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    want = COLUMNS[name.split("_")[0]]
    assert {k: kinds.get(k) for k in want} == want
    rows = df.toArrow()
    source = {"op1": "pages", "op11": "pages", "op2": None, "op5": None, "op10": None, "op12": None, "op13": None}.get(name.split("_")[0], "documents")
    if source:
        assert rows.num_rows == spark.read.parquet(f"{SF}/{source}.parquet").count()
    if name in SQL:
        duckdb = pytest.importorskip("duckdb")
        connection = duckdb.connect()
        for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        expected = connection.execute(SQL[name]).to_arrow_table()
        plain = lambda t: sorted(repr([round(v, 6) if isinstance(v, float) else v for _, v in sorted(r.items())]) for r in t.to_pylist())
        assert plain(rows) == plain(expected)
