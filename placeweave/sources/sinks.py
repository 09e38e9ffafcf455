"""Sinks: business rows (O5), run statistics (O6), export formats.

Writes are plain DataFrame writers, so they are task-parallel, retried per
task, and committed atomically per job by Spark's output committer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
# The reference pushed 50 records at a time; as file sizing this is a
# tuning knob, not semantics.
DEFAULT_MAX_RECORDS_PER_FILE = 1_000_000


def stamp(df: DataFrame, query=None, source_url=None, ts=None) -> DataFrame:
    """O5 stamps: ``query``, ``timestamp`` (+ ``source_url``).  Record fields
    win on a clash (the stamp only fills a column the rows do not have)."""
    out = df
    for name, value in (("query", query), ("source_url", source_url)):
        if value is not None and name not in out.columns:
            out = out.withColumn(name, F.lit(value))
    if "timestamp" not in out.columns:
        out = out.withColumn("timestamp", F.current_timestamp() if ts is None else F.lit(ts).cast("timestamp"))
    return out


def _flatten_for_text(df: DataFrame) -> DataFrame:
    """CSV needs scalars: arrays are ``; ``-joined, maps become JSON, the
    timestamp becomes ISO-8601 UTC text."""
    cols = []
    for name, dtype in df.dtypes:
        c = F.col(name)
        if dtype.startswith("array"):
            c = F.array_join(c, "; ")
        elif dtype.startswith("map") or dtype.startswith("struct"):
            c = F.to_json(c)
        elif dtype == "timestamp":
            c = F.date_format(c, ISO_UTC)
        cols.append(c.alias(name))
    return df.select(*cols)


def write_businesses(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append",
                     max_records_per_file: int = DEFAULT_MAX_RECORDS_PER_FILE, partition_by=None,
                     metrics: dict | None = None) -> dict:
    """Append business rows as parquet, JSON, CSV (flattened) or XML.

    ``metrics`` (name → aggregate column) are counted in the same pass as the
    rows are written; their values are returned."""
    seen = Observation() if metrics else None
    if seen is not None:
        df = df.observe(seen, *[c.alias(name) for name, c in metrics.items()])
    out = df
    if fmt in ("csv",):
        out = _flatten_for_text(df)
    elif fmt in ("json", "xml"):
        out = df.select(*[F.date_format(c, ISO_UTC).alias(c) if t == "timestamp" else F.col(c)
                          for c, t in df.dtypes])
    writer = out.write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("escape", "\"").csv(path)   # RFC 4180 quoting
    elif fmt == "xml":
        writer.option("rowTag", "business").option("rootTag", "businesses").format("xml").save(path)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.parquet(path)
    return dict(seen.get) if seen is not None else {}


def write_errors(errors: DataFrame, path: str, fmt: str = "json", mode: str = "append") -> None:
    """Error rows beside the results (their own folder)."""
    write_businesses(errors, path, fmt=fmt, mode=mode)


def write_stats(stats: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The run statistics (a one-row frame) as a single JSON file."""
    stats.coalesce(1).write.mode(mode).json(path)
