"""ST1: incremental capture on Structured Streaming.

Captured rows land in a folder; each micro-batch drops repeated deliveries of
the same key within the watermark (``dropDuplicatesWithinWatermark``), runs
the batch job on what is new and appends the result to a sink folder, one
sub-folder per micro-batch (``batch=<id>``, overwritten on retry, so a
replayed batch after an executor or driver loss is idempotent).  Readers get
"newest row per key" through :func:`latest_view` (R6 rule), which keeps the
sink append-only.

The checkpoint lives in the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeweave.session import checkpoint_dir


def start_capture(spark: SparkSession, source_dir: str, schema: str, sink_dir: str,
                  transform: Callable[[DataFrame], DataFrame], key: list[str], event_time: str,
                  watermark: str = "1 day", checkpoint: str | None = None, available_now: bool = True,
                  query_name: str | None = None, max_files: int | None = None):
    """Start the stream; returns the ``StreamingQuery``.  ``max_files`` bounds
    the new files of one micro-batch (all of them are read, batch by batch).

    ``transform`` is the batch job applied to each de-duplicated micro-batch
    (e.g. listing extraction for captured pages)."""
    # without an explicit checkpoint, one per sink and query name: two streams
    # never resume from each other's offsets
    sink = zlib.crc32(f"{sink_dir.rstrip('/')}|{query_name or ''}".encode())
    ckpt = checkpoint or f"{checkpoint_dir(spark)}/placeweave-stream/{query_name or 'capture'}-{sink:08x}"
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = (reader.parquet(source_dir)
              .withWatermark(event_time, watermark)
              .dropDuplicatesWithinWatermark(key))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (transform(batch).write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch={batch_id}"))

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
    if query_name:
        writer = writer.queryName(query_name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def latest_view(spark: SparkSession, sink_dir: str, key: str, ts: str, tiebreak: str) -> DataFrame:
    """Newest row per key across all appended batches."""
    rows = spark.read.parquet(sink_dir)
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tiebreak).desc())
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn", "batch")


def start_listing_capture(spark: SparkSession, source_dir: str, sink_dir: str, watermark: str = "1 day",
                          checkpoint: str | None = None, available_now: bool = True):
    """ST1 for captured pages: listing pages that land in ``source_dir``
    (captured-page schema) are de-duplicated by ``page_id`` within the
    watermark and run through X1 + L1–L12 per micro-batch; the rows keep the
    page's ``captured_at``.  Read the newest row per place with
    ``latest_view(spark, sink_dir, "placeId", "captured_at", "page_id")``."""
    from placeweave.operators.elements import page_elements
    from placeweave.operators.listing import listings
    from placeweave.plans.business_run import CAPTURED_PAGE_SCHEMA

    def extract(batch: DataFrame) -> DataFrame:
        pages = batch.filter(F.col("kind") == "listing")
        return listings(page_elements(pages, carry=("request_id", "region_pos", "captured_at")))

    return start_capture(spark, source_dir, CAPTURED_PAGE_SCHEMA, sink_dir, extract, key=["page_id"],
                         event_time="captured_at", watermark=watermark, checkpoint=checkpoint,
                         available_now=available_now, query_name=None)
