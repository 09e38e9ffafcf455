"""Rows of one row group are dealt out before rules that cost more than reading
them; X1's workers and the feed's state see bounded amounts."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from placeweave.operators.elements import MAX_ELEMENTS_PER_OUTPUT_BATCH, _flatten_batches
from placeweave.plans import catalog, q_captured, q_features
from placeweave.sources.tables import dealt
from placeweave.streaming.changes import two_newest


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """One file with one row group for each table."""
    base = str(tmp_path_factory.mktemp("tables"))
    keys = list(range(1, 241))
    pq.write_table(pa.table({"c_custkey": keys, "c_name": [f"Customer {k}" for k in keys], "c_nationkey": pa.array([k % 5 for k in keys], pa.int32()),
                             "c_mktsegment": ["BUILDING"] * len(keys)}), f"{base}/customer.parquet")
    pq.write_table(pa.table({"o_orderkey": list(range(2400)), "o_custkey": [1 + k % 240 for k in range(2400)]}), f"{base}/orders.parquet")
    pq.write_table(pa.table({"doc_id": keys, "text": [f"Road {k}" for k in keys], "n_chars": keys}), f"{base}/documents.parquet")
    return base


def parts(df):
    """Partitions that have rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_dealt_rows_stay_and_spread(spark):
    rows = [(i % 3 or None, "same") for i in range(400)]
    out = dealt(spark.createDataFrame(rows, "k long, t string").coalesce(1))
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, rows))
    assert len(sizes) >= 8 and max(sizes) < 100


@pytest.mark.parametrize("pages", [q_features.odd_cards, q_features.hidden_pages, q_features.odd_detail_pages, q_features.page_bytes,
                                   q_captured.detail_pages, q_captured.fragment_pages])
def test_built_pages_are_dealt(spark, tables, pages):
    out = pages(spark, tables)
    assert parts(out) >= 8 and out.count() == 240


@pytest.mark.parametrize("name", ["rule_values", "page_rules", "link_rules", "request_rules", "standardise_documents"])
def test_rules_see_dealt_rows(spark, tables, name):
    assert parts(catalog.QUERIES[name](spark, tables)) >= 8


def test_the_runs_tables_are_dealt(spark, tables, monkeypatch):
    seen = {}
    monkeypatch.setattr(q_captured.PL, "run", lambda requests, pages, **_: seen.update(requests=requests, pages=pages))
    q_captured._run(spark, tables)
    for kind, least in (("listing", 5), ("detail", 8), ("website", 8)):
        assert parts(seen["pages"].where(F.col("kind") == kind)) >= least
    assert seen["requests"].count() == 38


def test_x1_sends_small_batches_on():
    n, html = 3000, "<ul>" + "<li class=x>a</li>" * 30 + "</ul>"
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "url": ["u"] * n, "html": [None if i % 50 == 7 else html for i in range(n)]})
    out = list(_flatten_batches(iter([batch])))
    assert [i for b in out for i in b.column("page_id").to_pylist()] == list(range(n))
    assert max(len(b.column("elements").flatten()) for b in out) < 25_000 <= 5 * MAX_ELEMENTS_PER_OUTPUT_BATCH
    assert [e is None for b in out for e in b.column("parse_error").to_pylist()] == [i % 50 != 7 for i in range(n)]


@pytest.mark.parametrize("tie", [int, str])
def test_two_newest_rows_of_each_key(tie):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 5, 6, 7]), rng.choice([None, tie(1), tie(2)]), i) for i in range(80)] + [(9, None, None, 80)]
    got = two_newest(pa.table(dict(zip(("_key", "_at", "_tie", "_value"), map(list, zip(*rows))))))
    want = []
    for key in {r[0] for r in rows}:
        first = {}
        for k, at, t, v in rows:
            if k == key:
                first.setdefault((at, t), v)
        newest = sorted(first, key=lambda x: (x[0] is not None, x[0], x[1] is not None, x[1]), reverse=True)[:2]
        want += [(key, *x, first[x]) for x in newest]
    assert sorted(map(str, zip(*(got.column(c).to_pylist() for c in range(4))))) == sorted(map(str, want))
    one = pa.table({"_key": [{"a": 1}], "_at": [1], "_tie": [[1]], "_value": [1.0]})
    assert two_newest(one.select(["_key", "_at", "_tie", "_value"])).num_rows == 1
