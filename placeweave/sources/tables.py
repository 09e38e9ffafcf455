"""Table scans (O8 and the driver tables).

Scans are plain ``spark.read.parquet`` calls with a declared column list, so
Catalyst prunes columns and pushes filters into the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The captured-page schema.
PAGE_SCHEMA = "page_id BIGINT, url STRING, html STRING"
# Tables whose rows carry long texts and feed CPU-heavy per-row rules.
TEXT_TABLES = frozenset({"documents", "pages", "conversations"})


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


#: Session setting: deal the rows of text tables out over so many partitions.
SCAN_PARTITIONS = "placeweave.scan.partitions"


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly if the session asks for it, else ``df`` itself.

    On a cluster ``spark.sql.files.maxPartitionBytes`` gives the scan its
    tasks and nothing is shuffled.  One small file with a single row group
    cannot be split by the scan; whoever runs on such inputs may set
    ``placeweave.scan.partitions``.  The plan never depends on the input."""
    wanted = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted else df


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """The rows of ``df`` dealt out evenly over the session's tasks, for rules
    that cost far more than reading and moving their rows.

    A scan's tasks follow the file's row groups, and one row group may hold a
    million short rows: all rules would run in one task.  Rows are dealt by
    their place in the scan, so neither keys that repeat nor nulls meet; or by
    the columns ``by``, where groups of them are what comes next."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    if by:
        return df.repartition(parts, *by)
    return df.withColumn("_place", F.monotonically_increasing_id()).repartition(parts, "_place").drop("_place")


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str, spread_rows: bool | None = None) -> DataFrame:
    """Read one driver table; ``columns`` (optional) prunes the scan.  Text
    tables go through :func:`spread`."""
    df = spark.read.parquet(table_path(sf_dir, name))
    df = df.select(*columns) if columns else df
    if spread_rows or (spread_rows is None and name in TEXT_TABLES):
        df = spread(df)
    return df


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captured pages.  ``fmt='text'`` reads a folder of loose HTML files
    (one page per file, ``wholetext``), numbering pages by file path."""
    if fmt == "parquet":
        return spark.read.schema(PAGE_SCHEMA).parquet(path)
    raw = spark.read.text(path, wholetext=True)   # one row per file
    path_col = F.col("_metadata.file_path")
    return raw.select(F.xxhash64(path_col).alias("page_id"), path_col.alias("url"), F.col("value").alias("html"))
