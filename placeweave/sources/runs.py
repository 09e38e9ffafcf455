"""Appending a run's rows so that a repeated write adds nothing.

Every write of a run is an attempt with a folder of its own below ``rows``; the
run counts as written once its manifest row says which attempt holds it, with
the counts seen in the same pass.  A manifest row replaces the one before it by
a dynamic partition overwrite, so a retry, or a second writer of the same run,
swaps the whole run at once.  Readers join rows with the manifest: an attempt
that died half-way, and one that was replaced, are never seen.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.sources.sinks import write_businesses

#: Columns that name where a row is stored.
RUN, ATTEMPT = "run", "attempt"


def write_attempt(df: DataFrame, path: str, run: str, metrics: dict[str, Column] | None = None) -> tuple[str, dict]:
    """Write the rows of an attempt; they are not visible yet.  Returns the
    attempt and what was counted on the way."""
    attempt = uuid.uuid4().hex
    counted = write_businesses(df, f"{path}/rows/{RUN}={run}/{ATTEMPT}={attempt}", mode="overwrite",
                               metrics={"rows_written": F.count(F.lit(1)), **(metrics or {})})
    return attempt, counted


def commit(spark: SparkSession, path: str, run: str, attempt: str, counted: dict) -> None:
    """Make an attempt the run's content (O6: with its statistics)."""
    row = spark.range(1).select(F.lit(attempt).alias(ATTEMPT), F.to_json(F.create_map(
        *[F.lit(x) for k, v in counted.items() for x in (k, str(v))])).alias("counted"),
        F.current_timestamp().alias("committed_at"), F.lit(run).alias(RUN))
    (row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN).parquet(f"{path}/manifest"))


def append_run(df: DataFrame, path: str, run: str, metrics: dict[str, Column] | None = None) -> dict:
    """Append the rows of ``run`` to the table at ``path``; if the run is there
    already, they take its place.  ``df`` may not have columns ``run`` or
    ``attempt``.  Returns the counts."""
    taken = {c.lower() for c in df.columns} & {RUN, ATTEMPT}
    if taken:
        raise ValueError(f"reserved column names: {sorted(taken)}")
    attempt, counted = write_attempt(df, path, run, metrics)
    commit(df.sparkSession, path, run, attempt, counted)
    return counted


def manifest(spark: SparkSession, path: str, **kinds: str) -> DataFrame:
    """``(run, attempt, committed_at, …)``: what is committed; ``kinds`` names
    the counts to show and their types."""
    rows = spark.read.schema(f"{ATTEMPT} string, counted string, committed_at timestamp, {RUN} string").parquet(f"{path}/manifest")
    counts = F.from_json("counted", "map<string,string>")
    return rows.select(RUN, ATTEMPT, "committed_at", *[counts[name].cast(kind).alias(name) for name, kind in kinds.items()])


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed runs, with their ``run``.  The manifest has a
    row per run; the join prunes the partitions of other attempts."""
    rows = spark.read.schema(f"{schema}, {RUN} string, {ATTEMPT} string").parquet(f"{path}/rows")
    known = manifest(spark, path).select(F.col(RUN).alias("_run"), F.col(ATTEMPT).alias("_attempt"))
    return rows.join(known, (F.col(RUN) == F.col("_run")) & (F.col(ATTEMPT) == F.col("_attempt"))).drop("_run", "_attempt", ATTEMPT)
