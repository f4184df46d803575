"""Every query with SQL, against DuckDB on the smallest tables; every other one runs."""

import datetime
import os

import pytest

from loomspark.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(repr([plain(r[n]) for n in names]) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name in SQL:
        assert rows(got) == rows(duck.execute(SQL[name]).to_arrow_table())
    else:
        assert got.num_rows > 0
