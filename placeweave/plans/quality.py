"""Data-quality checks V1–V7, re-aimed from end-to-end test validators to
table checks.  Each returns the violating rows (or a per-column profile), so
a check is a filter or an aggregate — never a driver-side loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.functions.text import PRICE_RANGE
from placeweave.session import scratch_path

# Accepted place-id prefixes.
PLACE_ID_PREFIXES = ("ChI", "hex_", "generated_", "fallback_")
RATING_SHAPE = r"^[0-9.]+\s*\([0-9,]+\)$"      # the validator's own pattern (JavaScript)
RATING_SHAPE_JAVA = r"^[0-9.]+[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]*\([0-9,]+\)\z"


PLACE_ID_SHAPE = r"^(?:ChI|hex_|generated_|fallback_)[^?]*\z"


def place_id_ok(col="placeId"):
    """Well-formed place id.  Every predicate here reads its column once, so
    a filter pushed below the projection that computes the column inlines a
    single copy of it."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.rlike(PLACE_ID_SHAPE), F.lit(False))


def check_place_id(df: DataFrame, col: str = "placeId") -> DataFrame:
    """V1: place ids with a ``?`` or an unknown prefix (NULL fails too)."""
    return df.filter(~place_id_ok(col))


def address_ok(col="address"):
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(~c.rlike(RATING_SHAPE_JAVA), F.lit(True))


def check_address(df: DataFrame, col: str = "address") -> DataFrame:
    """V2: an address must not look like a rating; NULL is fine."""
    return df.filter(~address_ok(col))


def phone_ok(col="phone"):
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(~c.rlike(PRICE_RANGE), F.lit(True))


def check_phone(df: DataFrame, col: str = "phone") -> DataFrame:
    """V3: a phone must not look like a price range; NULL is fine."""
    return df.filter(~phone_ok(col))


def check_counts(df: DataFrame, key: str, min_rows: int | Column | None = None, max_rows: int | Column | None = None) -> DataFrame:
    """V4: groups whose row count is outside ``[min_rows, max_rows]``."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    bad = F.lit(False)
    if min_rows is not None:
        bad = bad | (F.col("n") < min_rows)
    if max_rows is not None:
        bad = bad | (F.col("n") > max_rows)
    return counts.filter(bad)


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """V5: non-null rate per column over all rows (the reference looked at the
    first row only), as ``(column, non_null, total, rate)`` rows."""
    cols = list(columns or df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("_total"),
                 *[F.count(F.col(c)).alias(f"_nn_{i}") for i, c in enumerate(cols)])
    stacked = agg.select("_total", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_nn_{i}").alias("non_null"))
        for i, c in enumerate(cols)])).alias("s"))
    return stacked.select(F.col("s.column").alias("column"), F.col("s.non_null").alias("non_null"),
                          F.col("_total").alias("total"),
                          F.when(F.col("_total") > 0, F.col("s.non_null") / F.col("_total")).alias("rate"))


def violations(df: DataFrame, row_id: str, checks: dict[str, str] | None = None) -> DataFrame:
    """V6: every failed check as ``(row_id, field, value)``; ``checks`` maps a
    column to one of ``place_id``, ``address``, ``phone``.

    One pass: each row yields an array of its failures, which is exploded —
    no filter on the checked columns, so Catalyst cannot push a check below
    the projection that computes the checked value."""
    checks = checks or {"placeId": "place_id", "address": "address", "phone": "phone"}
    tests = {"place_id": place_id_ok, "address": address_ok, "phone": phone_ok}
    present = [(c, k) for c, k in checks.items() if c in df.columns]
    fails = F.array(*[F.when(~tests[k](c), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")))
                      for c, k in present])
    from placeweave.operators.relational import explode_rows

    out = explode_rows(df.select(F.col(row_id).alias("row_id"),
                                 F.filter(fails, lambda x: x.isNotNull()).alias("_f")), ["row_id"], F.col("_f"), "v")
    return out.select("row_id", F.col("v.field").alias("field"), F.col("v.value").alias("value"))


def with_row_index(df: DataFrame, *order: Column | str, name: str = "row_index") -> DataFrame:
    """``df`` with the number of each row, from 0, in the given order.

    Rows are dealt out by range of the order and written with the number of
    their part, so bounds and numbers cannot change between two evaluations; a
    row's number is its place in its part plus the sizes of the parts before,
    one number per part.  No task holds all rows.  Rows that agree in the whole
    order are numbered one after the other."""
    spark = df.sparkSession
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    path = scratch_path(spark, "row-index")
    parts.write.parquet(path)
    parts = spark.read.schema(parts.schema).parquet(path)
    sizes = parts.groupBy(F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)       # one row per part
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (parts.withColumn("_place", place).join(F.broadcast(sizes), F.col("_part") == F.col("_of"))
            .withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_part", "_of", "_size", "_before", "_place"))


def violations_in_order(df: DataFrame, *order: Column | str, checks: dict[str, str] | None = None) -> DataFrame:
    """V6 as ``(row_index, field, value)``: the index of a failing row in the
    given order, as a list of results would have it."""
    return violations(with_row_index(df, *order), "row_index", checks).withColumnRenamed("row_id", "row_index")


def check_duration(log: DataFrame, max_ms: int, col: str = "duration_ms") -> DataFrame:
    """V7: runs slower than ``max_ms``."""
    return log.filter(F.col(col) > max_ms)
