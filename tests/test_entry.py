"""The driver contract, and the Spark-vs-DuckDB gate at sf0.001 (exact values)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def test_contract(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "host", "n_links", "n_emails", "email", "emails", "n_kept"]
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 40


def _canon(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle_matches(spark, duck, name):
    sdf = entry.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    got = sorted((tuple(_canon(x) for x in r) for r in sdf.select(*cols).collect()), key=repr)
    res = duck.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    order = sorted(range(len(dcols)), key=lambda i: dcols[i])
    want = sorted((tuple(_canon(r[i]) for i in order) for r in res.fetchall()), key=repr)
    assert cols == sorted(dcols)
    assert got == want
