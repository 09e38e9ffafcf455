"""A5, A8, R2 and the change feed on hard data: outliers, hot groups, ties, nulls."""

import datetime as dt
import math
import random

import pytest

from placeweave.plans import analyses as AN
from placeweave.plans import metrics as M
from placeweave.streaming.changes import current, start_changes

T0 = dt.datetime(2024, 1, 1)


def run_log(spark, rows, parts=4):
    """rows: (scenario, duration, success)"""
    full = [(str(i), "q", "c", s, T0 + dt.timedelta(seconds=i), d, ok, 1, None) for i, (s, d, ok) in enumerate(rows)]
    return spark.createDataFrame(full, M.RUN_LOG_SCHEMA).repartition(parts)


def plain_percentiles(values):
    v = sorted(values)
    return tuple(v[math.floor(len(v) * p)] for _, p in M.PERCENTILES)


def percentiles(df):
    return sorted(((r.scenario, r.n, (r.p50, r.p90, r.p95, r.p99)) for r in df.collect()), key=str)


@pytest.mark.parametrize("parts", [1, 8, 50])
def test_a5_does_not_depend_on_distribution_or_partitions(spark, parts):
    rng = random.Random(3)
    rows = [("hot", rng.randrange(20_000), True) for _ in range(3000)] + [("hot", 10 ** 12, True), ("hot", -(1 << 63), True), ("hot", (1 << 63) - 1, True)]
    rows += [("cold", rng.choice([-5, 0, 7, 7, 7]), False) for _ in range(300)] + [("one", 42, True), ("none", None, True), (None, 9, True), (None, 8, True)]
    rows += [("ALL", 1, True)]
    got = percentiles(M.latency_percentiles(run_log(spark, rows, parts)))
    by = {}
    for s, d, _ in rows:
        if d is not None:
            by.setdefault(s, []).append(d)
    want = [(s, len(v), plain_percentiles(v)) for s, v in by.items()] + [("ALL", sum(map(len, by.values())), plain_percentiles(sum(by.values(), [])))]
    assert got == sorted(want, key=str) and len(got) == 6


def test_a5_under_other_plans(spark):
    rng = random.Random(4)
    log = run_log(spark, [(rng.choice("abc"), int(rng.lognormvariate(8, 3)), True) for _ in range(2000)])
    want = percentiles(M.latency_percentiles(log))
    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.exchange.reuse", "false"),
                       ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.shuffle.partitions", "50")):
        old = spark.conf.get(key)
        spark.conf.set(key, value)
        try:
            assert percentiles(M.latency_percentiles(log)) == want
        finally:
            spark.conf.set(key, old)


def test_a5_windows_hold_digits_not_values(spark):
    plan = M.latency_percentiles(run_log(spark, [("a", 1, True)]))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_digit" in w and "_all" in w for w in windows)


def test_a8_keeps_every_scenario(spark):
    rows = [("fast", 10, True)] * 20 + [("slow", 70_000, True)] * 19 + [("slow", 1, False)] + [(None, 5, False)] * 3 + [("untimed", None, True)] * 2
    got = {r.scenario: (r.band, r.slow_p95, r.high_failure) for r in M.verdict(run_log(spark, rows)).collect()}
    assert got == {"fast": ("pass", False, False), "slow": ("pass", True, False), None: ("fail", False, True),
                   "untimed": ("pass", False, False), "ALL": ("partial", True, False)}


# -- R2 ----------------------------------------------------------------------

def plain_ranks(rows, tie):
    out = []
    for g, s, i in rows:
        def order(r):
            return (r[1] is None, -(r[1] or 0), *((r[2],) if tie else ()))
        out.append((g, s, i, 1 + sum(order(r) < order((g, s, i)) for r in rows if r[0] == g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("tie", [True, False])
def test_r2_ranks_of_a_hot_group(spark, tie):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([1.0, 2.5, 2.5, 3.0, None, rng.random() * 5]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, s double, i long").repartition(7)
    ranked = AN.rating_rank(df, "g", "s", tiebreak="i" if tie else None)
    got = sorted(((r.g, r.s, r.i, r["rank"]) for r in ranked.collect()), key=str)
    assert got == plain_ranks(rows, tie)
    for r in ranked.collect():
        mine = [s for g, s, _ in rows if g == r.g]
        assert r.group_n == len(mine) and r.group_max == max(x for x in mine if x is not None)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert all("_part" in line for line in plan.splitlines() if "Window [" in line)


def test_r2_top_k_equals_the_whole_ranking(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(rng.choice("ab"), float(rng.randrange(40)), i) for i in range(300)], "g string, s double, i long")
    every = {tuple(r) for r in AN.rating_rank(df, "g", "s", tiebreak="i").where("rank <= 5").select("g", "s", "i", "rank").collect()}
    assert {tuple(r) for r in AN.rating_rank(df, "g", "s", top_k=5, tiebreak="i").select("g", "s", "i", "rank").collect()} == every


def test_r2_distribution(spark):
    df = spark.createDataFrame([("a", 4.2), ("a", 4.9), ("a", 3.0), ("a", None), ("b", 1.0), (None, 2.0)], "g string, s double")
    got = {(r.g, r.band): (r.n, r.share, r.share_upto) for r in AN.rating_distribution(df, "g", "s").collect()}
    assert got == {("a", None): (1, .25, .25), ("a", 3.0): (1, .25, .5), ("a", 4.0): (2, .5, 1.0), ("b", 1.0): (1, 1.0, 1.0), (None, 2.0): (1, 1.0, 1.0)}


# -- the change feed ---------------------------------------------------------

DDL = "k STRING, id BIGINT, at TIMESTAMP, v STRING"


def test_changes_add_up_to_the_snapshot(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", "c", None]), i, T0 + dt.timedelta(minutes=rng.randrange(500)), rng.choice(["x", "y", None])) for i in range(120)]
    rows.append(("d", 1000, None, "z"))
    rng.shuffle(rows)
    src, sink, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    seen = []
    for part in (rows[:50], rows[50:90] + rows[:20], rows[90:], rows):        # repeats, late rows, a restart each time
        spark.createDataFrame(part, DDL).coalesce(2).write.mode("append").parquet(src)
        start_changes(spark, src, DDL, sink, "k", "at", "id", "v", checkpoint=ck, max_files=1).awaitTermination()
        seen = list({*seen, *part})
        want = AN.latest_snapshot(spark.createDataFrame(seen, DDL), "k", "at", "id", "v")
        cols = ["k", "latest_id", "latest_at", "latest_v", "previous_v", "changed"]
        now = current(spark, sink, "k").select(*cols)
        assert sorted(map(tuple, now.collect()), key=str) == sorted(map(tuple, want.select(*cols).collect()), key=str)
    feed = spark.read.parquet(sink)
    n = feed.count()
    assert feed.groupBy("k", "seq").count().where("count > 1").count() == 0
    # everything once more: nothing changes, nothing is emitted
    spark.createDataFrame(rows, DDL).write.mode("append").parquet(src)
    start_changes(spark, src, DDL, sink, "k", "at", "id", "v", checkpoint=ck).awaitTermination()
    assert spark.read.parquet(sink).count() == n < len(rows) + 4


def test_a_change_says_what_it_replaced(spark, tmp_path):
    src, sink, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    minutes = [(10, "x"), (20, "y"), (15, "w"), (5, "u"), (30, "y")]          # the third is late but newer than the first
    for i, (m, v) in enumerate(minutes):
        spark.createDataFrame([("a", i, T0 + dt.timedelta(minutes=m), v)], DDL).write.mode("append").parquet(src)
        start_changes(spark, src, DDL, sink, "k", "at", "id", "v", checkpoint=ck).awaitTermination()
    got = [(r.seq, r.latest_v, r.previous_v, r.changed) for r in spark.read.parquet(sink).orderBy("seq").collect()]
    assert got == [(1, "x", None, None), (2, "y", "x", True), (3, "y", "w", True), (4, "y", "y", False)]
    assert [r.latest_id for r in current(spark, sink, "k").collect()] == [4]
