"""Array helpers whose results do not depend on the ANSI setting.

With ANSI off, Spark's ``size(NULL)`` is -1 (legacy); with ANSI on it is NULL.
These helpers spell the intended result out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size0(arr: Column) -> Column:
    """Number of elements; a NULL array counts as 0."""
    return F.when(arr.isNull(), F.lit(0)).otherwise(F.size(arr))


def size_or_null(arr: Column) -> Column:
    """Number of elements; NULL for a NULL array (as SQL ``len``)."""
    return F.when(arr.isNotNull(), F.size(arr))
