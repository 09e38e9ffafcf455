"""Plan regressions for the scale properties the jobs rely on."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from placeweave.operators.relational import dedupe_first, limit_per_query

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_first_wins_and_top_n_limit_map_side(spark):
    rows = [(k % 3, i, i) for k in range(200) for i in range(5)]
    df = spark.createDataFrame(rows, "key int, pos int, v int")
    for out in (dedupe_first(df, ["key"], ["pos"]), limit_per_query(df, "key", ["pos"], limit=3),
                limit_per_query(df.withColumn("max_results", F.lit(2)), "key", ["pos"], bound=200)):
        plan = _plan(out)
        assert "WindowGroupLimit" in plan and "Partial" in plan, plan


def test_extraction_runs_once(spark):
    queries = entry.queries()
    for name in ("listings", "detail_fields", "page_elements"):
        plan = _optimized(queries[name](spark, SF))
        assert plan.count("MapInArrow") == 1, name
        assert "Filter (size(" not in plan, name           # no inferred generate filter re-running rules
    run_plan = _optimized(queries["business_rows"](spark, SF))
    assert run_plan.count("MapInArrow") <= 3                  # listing, detail and website pages once each


def test_filters_stay_above_the_spread(spark):
    # nothing is spread unless the session asks; then the checked values are
    # computed after the round-robin spread, once
    for name in ("violations", "document_phones"):
        assert "Repartition" not in _optimized(entry.queries()[name](spark, SF)), name
        spark.conf.set("placeweave.scan.partitions", "6")
        try:
            plan = _optimized(entry.queries()[name](spark, SF))
        finally:
            spark.conf.unset("placeweave.scan.partitions")
        assert "Repartition" in plan, name
        below_spread = plan.split("Repartition")[-1]
        assert "regexp" not in below_spread, name
