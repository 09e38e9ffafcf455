"""Registered queries for X1 over raw pages, quality completeness (V5), sinks
(O5–O7) and streaming (ST1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.operators import elements as X
from placeweave.plans import quality as V
from placeweave.plans.q_tables import LATEST_SNAPSHOT_SQL
from placeweave.plans.registry import register
from placeweave.session import scratch_path
from placeweave.sources import sinks
from placeweave.sources.tables import dealt, load
from placeweave.streaming.capture import latest_view, start_capture
from placeweave.streaming.changes import current, start_changes


def _pages_x1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.page_elements(load(spark, sf_dir, "pages", "page_id", "url", "html"))


@register("page_elements")
def page_elements_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 over every page: element, text-node and link counts, depth, title."""
    pe = _pages_x1(spark, sf_dir)
    title = X.text_of(F.try_element_at(F.filter("elements", lambda e: e["tag"] == "title"), F.lit(1)))
    return pe.select(
        "page_id",
        F.size("elements").alias("n_elements"), F.size("text_nodes").alias("n_text_nodes"),
        F.length(X.page_text_of()).alias("text_chars"),
        F.aggregate("elements", F.lit(0), lambda a, e: F.greatest(a, e["depth"])).alias("max_depth"),
        F.size(F.filter("elements", lambda e: (e["tag"] == "a") & X.has_attr(e, "href"))).alias("n_links"),
        title.alias("title"))


@register("completeness", """
WITH j AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
           FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT 'doc_id' AS column_name, count(doc_id) AS non_null, count(*) AS total, count(doc_id) / count(*) AS rate FROM j
UNION ALL SELECT 'lang', count(lang), count(*), count(lang) / count(*) FROM j
UNION ALL SELECT 'source', count(source), count(*), count(source) / count(*) FROM j
UNION ALL SELECT 'n_chars', count(n_chars), count(*), count(n_chars) / count(*) FROM j
UNION ALL SELECT 'quality', count(quality), count(*), count(quality) / count(*) FROM j
UNION ALL SELECT 'toxic', count(toxic), count(*), count(toxic) / count(*) FROM j
""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: non-null rate of every column of documents ⟕ labels."""
    docs = load(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars")
    labels = load(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    j = docs.join(labels, "doc_id", "left")
    return V.completeness(j, ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]) \
        .withColumnRenamed("column", "column_name")


SUPPLIER_DDL = "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE"


@register("export_roundtrip", """
SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier
""")
def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as JSON, read back, written as CSV, read back,
    written as XML and read back (schemas declared, never inferred) in the
    shared checkpoint folder."""
    base = scratch_path(spark, "export")
    sup = load(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    sinks.write_businesses(sup, f"{base}/json", fmt="json", mode="overwrite")
    back = spark.read.schema(SUPPLIER_DDL).json(f"{base}/json")
    sinks.write_businesses(back, f"{base}/csv", fmt="csv", mode="overwrite")
    back = spark.read.schema(SUPPLIER_DDL).option("header", True).option("escape", "\"").csv(f"{base}/csv")
    sinks.write_businesses(back, f"{base}/xml", fmt="xml", mode="overwrite")
    return spark.read.format("xml").option("rowTag", "business").schema(SUPPLIER_DDL).load(f"{base}/xml")


EVENTS_DDL = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


@register("incremental_capture", """
SELECT user_id, event_id, value, n_captured FROM (
  SELECT *, count(*) OVER (PARTITION BY user_id) AS n_captured,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1
""")
def incremental_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: the events land in several deliveries.  The first run reads them
    in two micro-batches; then everything is delivered again, with a copy of
    each event dated beyond the watermark, and a second run resumes from the
    checkpoint.  Repeats and late rows are dropped, so each user's newest row
    (R6) and number of captured rows are those of the table."""
    base = scratch_path(spark, "capture")
    landing = f"{base}/landing"
    events = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))

    def capture(files: int):
        start_capture(spark, landing, EVENTS_DDL, f"{base}/sink",
                      transform=lambda b: b.select("user_id", "event_id", "ts", "value"),
                      key=["event_id"], event_time="ts", watermark="31 days",
                      checkpoint=f"{base}/checkpoint", max_files=files).awaitTermination()

    deliver(events.where("event_id % 2 = 0"), landing)
    capture((deliver(events.where("event_id % 2 = 1"), landing) + 1) // 2)
    late = events.withColumn("event_id", F.col("event_id") + 1_000_000_000_000).withColumn("ts", F.col("ts") - F.expr("INTERVAL 90 DAYS"))
    capture(deliver(events.unionByName(late), landing))
    counts = spark.read.parquet(f"{base}/sink").groupBy(F.col("user_id").alias("u")).agg(F.count(F.lit(1)).alias("n_captured"))
    newest = latest_view(spark, f"{base}/sink", "user_id", "ts", "event_id")
    return newest.join(counts, newest["user_id"] == counts["u"]).select("user_id", "event_id", "value", "n_captured")


def deliver(rows: DataFrame, landing: str) -> int:
    """Append ``rows`` as files of the tasks' own; returns the files there."""
    rows.write.mode("append").parquet(landing)
    return len(rows.sparkSession.read.parquet(landing).inputFiles())


@register("change_feed", LATEST_SNAPSHOT_SQL)
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 + R6 as state: two thirds of the events, then the rest (older and
    newer than what is known) with half of the first delivery once more, then
    everything again, each read by a run that resumes from the checkpoint.
    What the feed's changes add up to is the snapshot of the whole table."""
    base = scratch_path(spark, "changes")
    landing = f"{base}/landing"
    events = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = events.where("event_id % 3 <> 0")
    for rows, batches in ((first, 2), (events.where("event_id % 3 = 0").unionByName(first.where("event_id % 2 = 0")), 1), (events, 1)):
        files = deliver(dealt(rows), landing)
        start_changes(spark, landing, EVENTS_DDL, f"{base}/sink", "user_id", "ts", "event_id", "value",
                      checkpoint=f"{base}/checkpoint", max_files=max(1, files // batches)).awaitTermination()
    return current(spark, f"{base}/sink", "user_id").select("user_id", "latest_event_id", "latest_value", "previous_value", "changed")
