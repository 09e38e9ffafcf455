"""Run statistics and load metrics (A1–A8) over a run log.

Run-log schema: ``run_id, query, category, scenario, started_at, duration_ms,
success, result_count, error``.  Every metric is a grouped aggregate with
map-side partial aggregation; percentiles (A5) use a histogram of distinct
durations per scenario, so no task ever sorts all runs of a hot scenario.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The load-test verdict thresholds.
PASS_RATE = 0.95
PARTIAL_RATE = 0.80
P95_LIMIT_MS = 60_000
FAILURE_LIMIT = 0.10
THROUGHPUT_FLOOR = 0.5
PERCENTILES = (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))

RUN_LOG_SCHEMA = ("run_id STRING, query STRING, category STRING, scenario STRING, started_at TIMESTAMP_NTZ, "
                  "duration_ms BIGINT, success BOOLEAN, result_count BIGINT, error STRING")


def run_log_from_events(events: DataFrame) -> DataFrame:
    """The driver's ``events`` table read as a run log: one run per event,
    ``error`` events failed, ``value`` seconds of run time, ``props.k``
    results, the weekday as load scenario and the day as test category."""
    k = F.regexp_extract("props", r'"k":[ ]*(-?[0-9]+)', 1)
    failed = F.col("event_type") == "error"
    duration = F.round(F.col("value") * 1000).cast("long")
    message = (F.when(F.col("value") >= 100, F.lit("Navigation timeout"))
               .when(k.try_cast("long") >= 50, F.lit("Selector not found"))
               .otherwise(F.lit("Extraction failed")))
    return events.select(
        F.col("event_id").cast("string").alias("run_id"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("query"),
        F.date_format("ts", "yyyy-MM-dd").alias("category"),
        F.date_format("ts", "EEEE").alias("scenario"),
        F.col("ts").alias("started_at"),
        duration.alias("duration_ms"),
        (~failed).alias("success"),
        F.nullif(k, F.lit("")).try_cast("long").alias("result_count"),
        F.when(failed, message).alias("error"))


def _half_up(x):
    return F.floor(x + F.lit(0.5))


def run_summary(log: DataFrame, by: str | None = "category") -> DataFrame:
    """A1: searches, results (of successful runs), failures, rounded average
    results per search, rounded success percentage as text, and elapsed
    seconds — one row per ``by`` group (one run) or one row overall."""
    groups = [by] if by else []
    end = F.col("started_at") + F.make_dt_interval(secs=F.col("duration_ms") / 1000)
    agg = (log.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total_searches"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("result_count"))), F.lit(0)).cast("long").alias("total_results"),
        F.count_if(~F.col("success")).alias("failed_searches"),
        F.min("started_at").alias("_start"), F.max(end).alias("_end")))
    ok = F.col("total_searches") - F.col("failed_searches")
    return agg.select(
        *groups, "total_searches", "total_results", "failed_searches",
        F.when(F.col("total_searches") > 0, _half_up(F.col("total_results") / F.col("total_searches")))
        .otherwise(0).cast("long").alias("avg_results_per_search"),
        F.when(F.col("total_searches") > 0,
               F.concat(_half_up(ok / F.col("total_searches") * 100).cast("long").cast("string"), F.lit("%")))
        .otherwise(F.lit("0%")).alias("success_rate"),
        _half_up(F.timestamp_diff("MICROSECOND", F.col("_start"), F.col("_end")) / 1000000).cast("long")
        .alias("duration_s"))


def rate_by_category(log: DataFrame, category: str = "category") -> DataFrame:
    """A3: passed/failed/total and pass rate (2 decimals) per category, plus a
    total row (``category = 'ALL'``) from a roll-up."""
    agg = log.rollup(category).agg(
        F.count_if("success").alias("passed"), F.count_if(~F.col("success")).alias("failed"),
        F.count(F.lit(1)).alias("total"), F.grouping(category).alias("_g"))
    return agg.select(
        F.when(F.col("_g") == 1, F.lit("ALL")).otherwise(F.col(category)).alias(category),
        "passed", "failed", "total",
        (_half_up(F.col("passed") * 10000.0 / F.col("total")) / 100).alias("pass_rate"))


def latency_stats(log: DataFrame, by: str = "scenario") -> DataFrame:
    """A4: min/max/mean duration and success/failure counts per scenario and
    overall (``scenario = 'ALL'``)."""
    agg = log.rollup(by).agg(
        F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"),
        (F.floor(F.sum("duration_ms") * 1000.0 / F.count(F.lit(1)) + 0.5) / 1000).alias("avg_ms"),
        F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"),
        F.grouping(by).alias("_g"))
    return agg.select(F.when(F.col("_g") == 1, F.lit("ALL")).otherwise(F.col(by)).alias(by),
                      "min_ms", "max_ms", "avg_ms", "successes", "failures")


#: A5 reads values from the top, so many bits at a time.
_DIGIT_BITS = 16
_LOWEST = -(1 << 63)


def _percentiles(log: DataFrame, by: str, value: str) -> DataFrame:
    """``(_all, _grp, n, p50, p90, p95, p99)``; ``_all`` marks the overall row.

    Selection by digits: values are integers, read as 64 bits in order of size.
    A level counts, for each wanted rank, the digits that follow the prefix
    found so far, and running counts say in which digit the rank lies.  Only
    values under a wanted prefix are counted, a window holds at most
    2 ** _DIGIT_BITS counts, and after the last digit the prefix is the value,
    whatever the distribution."""
    own = (log.filter(F.col(value).isNotNull()).groupBy(F.col(by).cast("string").alias("_grp"), F.col(value).cast("long").alias("_v"))
           .agg(F.count(F.lit(1)).alias("_n")))
    overall = own.groupBy("_v").agg(F.sum("_n").alias("_n")).select(F.lit(None).cast("string").alias("_grp"), "_v", "_n")
    hist = (own.withColumn("_all", F.lit(False)).unionByName(overall.withColumn("_all", F.lit(True)))
            .select(F.col("_all").alias("_h_all"), F.col("_grp").alias("_h_grp"),
                    F.col("_v").bitwiseXOR(F.lit(_LOWEST)).alias("_k"), "_n"))
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("p"), (F.floor(F.col("n") * p) + 1).alias("rank")) for name, p in PERCENTILES]))
    wanted = (hist.groupBy(F.col("_h_all").alias("_all"), F.col("_h_grp").alias("_grp")).agg(F.sum("_n").alias("n"))
              .select("_all", "_grp", "n", ranks.alias("_r"), F.lit(0).cast("long").alias("_prefix"))
              .select("_all", "_grp", "n", "_prefix", F.col("_r.p").alias("_p"), F.col("_r.rank").alias("_rank")))
    for shift in range(64 - _DIGIT_BITS, -1, -_DIGIT_BITS):
        known = F.lit(0).cast("long") if shift + _DIGIT_BITS == 64 else F.shiftrightunsigned("_k", shift + _DIGIT_BITS)
        digit = F.shiftrightunsigned("_k", shift).bitwiseAND(F.lit((1 << _DIGIT_BITS) - 1).cast("long"))
        level = hist.select("_h_all", "_h_grp", known.alias("_known"), digit.alias("_digit"), "_n")
        of = (F.col("_h_all") == F.col("_all")) & F.col("_h_grp").eqNullSafe(F.col("_grp")) & (F.col("_known") == F.col("_prefix"))
        counts = (level.join(wanted, of).groupBy("_all", "_grp", "n", "_p", "_rank", "_prefix", "_digit").agg(F.sum("_n").alias("_here")))
        upto = F.sum("_here").over(Window.partitionBy("_all", "_grp", "_p").orderBy("_digit")
                                   .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        wanted = (counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_here") < F.col("_rank")))
                  .select("_all", "_grp", "n", F.shiftleft("_prefix", _DIGIT_BITS).bitwiseOR(F.col("_digit")).alias("_prefix"), "_p",
                          (F.col("_rank") - (F.col("_upto") - F.col("_here"))).alias("_rank")))
    found = F.col("_prefix").bitwiseXOR(F.lit(_LOWEST))
    return wanted.groupBy("_all", "_grp").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("_p") == name, found)).alias(name) for name, _ in PERCENTILES])


def latency_percentiles(log: DataFrame, by: str = "scenario", value: str = "duration_ms") -> DataFrame:
    """A5: p50/p90/p95/p99 as the element at 0-based index ``floor(n·p)`` of the
    sorted values (upper nearest rank), per scenario and overall (``ALL``).

    Exact, lazy, and the same under any partitioning: rows become a histogram
    ``(scenario, value, count)`` by a partial aggregate, the ranks are found by
    :func:`_percentiles` digit by digit, so neither a hot scenario nor an
    outlier brings many values into one task.  ``value`` is an integer column;
    null values do not count; a scenario that is null, or named ``ALL``, has a
    row of its own."""
    found = _percentiles(log, by, value)
    return found.select(F.when(F.col("_all"), F.lit("ALL")).otherwise(F.col("_grp")).alias(by), "n", *[name for name, _ in PERCENTILES])


def latency_percentiles_approx(log: DataFrame, by: str = "scenario", value: str = "duration_ms",
                               accuracy: int = 10000) -> DataFrame:
    """A5, approximate variant (T8): ``percentile_approx`` per scenario and
    overall — one pass, mergeable sketches, bounded memory per group."""
    probs = [p for _, p in PERCENTILES]
    agg = log.rollup(by).agg(F.count(F.lit(1)).alias("n"),
                             F.percentile_approx(value, probs, accuracy).alias("_q"), F.grouping(by).alias("_g"))
    return agg.select(F.when(F.col("_g") == 1, F.lit("ALL")).otherwise(F.col(by)).alias(by), "n",
                      *[F.col("_q")[i].alias(name) for i, (name, _) in enumerate(PERCENTILES)])


def throughput(log: DataFrame, by: str = "scenario") -> DataFrame:
    """Runs per elapsed second (first start to last end) per scenario and
    overall."""
    end = F.col("started_at") + F.make_dt_interval(secs=F.col("duration_ms") / 1000)
    agg = log.rollup(by).agg(F.count(F.lit(1)).alias("runs"), F.min("started_at").alias("_s"),
                             F.max(end).alias("_e"), F.grouping(by).alias("_g"))
    # Microseconds are the native precision of both engines: exact.
    elapsed_us = F.timestamp_diff("MICROSECOND", F.col("_s"), F.col("_e"))
    return agg.select(F.when(F.col("_g") == 1, F.lit("ALL")).otherwise(F.col(by)).alias(by), "runs",
                      F.floor(elapsed_us / 1000).cast("long").alias("elapsed_ms"),
                      F.when(elapsed_us > 0, F.col("runs") / (elapsed_us / 1000000.0)).alias("runs_per_s"))


def error_histogram(log: DataFrame) -> DataFrame:
    """Count of failed runs by error message."""
    return log.filter(~F.col("success")).groupBy(F.coalesce("error", F.lit("")).alias("error")) \
        .agg(F.count(F.lit(1)).alias("n"))


def verdict(log: DataFrame, by: str = "scenario") -> DataFrame:
    """Success band (pass ≥ 0.95, partial ≥ 0.80, else fail) and the
    p95 > 60 s, failure > 10 % and throughput < 0.5 runs/s warnings, per
    scenario and overall.  Counts and elapsed time come from one roll-up; the
    p95 from the distributed percentile job; the two are joined on the
    (small) scenario key."""
    end = F.col("started_at") + F.make_dt_interval(secs=F.col("duration_ms") / 1000)
    agg = log.rollup(by).agg(
        F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"),
        F.count(F.lit(1)).alias("runs"), F.min("started_at").alias("_s"), F.max(end).alias("_e"),
        F.grouping(by).alias("_g"))
    stats = agg.select(F.when(F.col("_g") == 0, F.col(by).cast("string")).alias(by), (F.col("_g") == 1).alias("_total"),
                       "successes", "failures", "runs",
                       F.timestamp_diff("MICROSECOND", F.col("_s"), F.col("_e")).alias("_us"))
    pct = _percentiles(log, by, "duration_ms").select("_all", "_grp", "p95")
    total = F.col("successes") + F.col("failures")
    rate = F.col("successes") / total
    runs_per_s = F.when(F.col("_us") > 0, F.col("runs") / (F.col("_us") / 1000000.0))
    return (stats.join(pct, (F.col("_total") == F.col("_all")) & F.col(by).eqNullSafe(F.col("_grp")), "left")
            .select(F.when(F.col("_total"), F.lit("ALL")).otherwise(F.col(by)).alias(by), rate.alias("success_rate"),
                    F.when(rate >= PASS_RATE, F.lit("pass")).when(rate >= PARTIAL_RATE, F.lit("partial"))
                    .otherwise(F.lit("fail")).alias("band"),
                    F.coalesce(F.col("p95") > P95_LIMIT_MS, F.lit(False)).alias("slow_p95"),
                    (F.col("failures") / total > FAILURE_LIMIT).alias("high_failure"),
                    F.coalesce(runs_per_s < THROUGHPUT_FLOOR, F.lit(False)).alias("low_throughput")))


def end_to_end_verdict(log: DataFrame, by: str) -> DataFrame:
    """A8, end-to-end band per ``by``: ``pass`` when no run failed, ``partial``
    when at least ``PARTIAL_RATE`` of them succeeded, else ``fail``."""
    agg = log.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("success")).alias("failures"))
    rate = (F.col("runs") - F.col("failures")) / F.col("runs")
    return agg.select(by, "runs", "failures",
                      F.when(F.col("failures") == 0, F.lit("pass")).when(rate >= PARTIAL_RATE, F.lit("partial"))
                      .otherwise(F.lit("fail")).alias("band"))
