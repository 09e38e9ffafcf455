"""Helpers shared by the training-data operators.

Texts are null, empty or very long; doc ids may be null or repeat.  A row is
named by ``(doc_id, row_key)``: ``row_key`` hashes the id and the whole text,
so equal rows share one name (and one result) and rows that only share an id
do not.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from placeweave.session import scratch_path
from placeweave.sources.tables import spread

# A word, as all contracts define it: what ASCII white space leaves.
# ``bytes.split()`` cuts at exactly these bytes.
WORD = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; dealt out evenly only where the session asks for it."""
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` below the shared checkpoint folder and
    read it back, so a lost executor never repeats the work above."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has (any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"__{name}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out.append(new)
    return out


def map_rows(df: DataFrame, run, **kinds: str) -> DataFrame:
    """``df.mapInArrow(run)`` where ``run`` gives the columns of its batches,
    all or some rows, plus columns ``n0``, ``n1``, … of the given kinds, which
    get their names here.  Columns may have any names (dots, say)."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = StructType(list(plain.schema.fields))
    for i, kind in enumerate(kinds.values()):
        schema = schema.add(f"n{i}", kind)
    return plain.mapInArrow(run, schema).toDF(*df.columns, *kinds)


def md5_long(column) -> F.Column:
    """60 bits of a string's MD5 as a LONG (the same in any SQL engine)."""
    return F.conv(F.substring(F.md5(column), 1, 15), 16, 10).cast("long")


def held_out(parts: int, part: int, doc_id: str = "doc_id") -> F.Column:
    """Rows whose ids no model may learn from: the CRC-32 of the id as text
    leaves the remainder ``part`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == part


def row_key(doc_id: str = "doc_id", text: str = "text") -> F.Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def text_bytes(value: str | None) -> bytes:
    """UTF-8 bytes of a text; unpaired surrogates, if any, are kept apart."""
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def estimate_bytes(docs: DataFrame, text: str = "text") -> int:
    """Exact number of text bytes (one cheap aggregate over one column)."""
    row = docs.agg(F.sum(F.octet_length(F.col(text)))).first()
    return int(row[0] or 0)


def bucket_count(spark: SparkSession, items: int, per_bucket: int, each: int = 4) -> int:
    """So many hash buckets that one holds about ``per_bucket`` items.  Where
    that gives too few for the shuffle partitions (buckets are dealt out by
    hash), ``each`` per partition, but none of under a 64th of ``per_bucket``:
    each task sends a row per bucket, and rows should be worth sending."""
    spread = each * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-items // per_bucket), min(spread, -(-64 * items // per_bucket)))


def runs(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions as (first, length) of their unbroken runs."""
    if not len(positions):
        return positions, positions
    cut = np.flatnonzero(np.diff(positions) != 1) + 1
    first = positions[np.r_[0, cut]]
    last = positions[np.r_[cut - 1, len(positions) - 1]]
    return first, last - first + 1


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open spans in any order as disjoint maximal spans in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    first = np.flatnonzero(new)
    return starts[first], ends[np.r_[first[1:] - 1, len(ends) - 1]]


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (multiply and shift, twice)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h
