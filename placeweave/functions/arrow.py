"""Narrow Arrow passes over one column of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def map_column(df: DataFrame, column: str, fn: Callable, kinds: dict[str, str]) -> DataFrame:
    """All columns of ``df`` but ``column``, and a column of each of ``kinds``
    (name → string or another scalar type) from the tuple that ``fn`` makes of
    its value.  Other columns pass through untouched, whatever their names."""
    at = [f.name for f in df.schema.fields].index(column)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.schema.fields))])
    schema = StructType([f for i, f in enumerate(plain.schema.fields) if i != at])
    for i, kind in enumerate(kinds.values()):
        schema = schema.add(f"n{i}", kind)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fn(v) for v in batch.column(at).to_pylist()]
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            new = [pa.array([m[i] for m in made], pa.string() if kind == "string" else None) for i, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=names)

    rest = [f.name for i, f in enumerate(df.schema.fields) if i != at]
    return plain.mapInArrow(run, schema).toDF(*rest, *kinds)
