"""ST1/R6: a feed of changes, kept as state.

For every key the two newest captures (by event time, then tie-break) live in
the state store.  A micro-batch sends a key's new rows to its state and emits
one row only if they change something: the newest capture, or the one before
it.  Repeated deliveries and late rows that are older than both change nothing;
a late row in between is put in its place, so the feed does not depend on the
order of arrival.  Tasks send on only the two newest captures that they see of
a key among some rows, so state is asked once per key, not per capture.

Each change carries its number within the key, so the present state of all
keys is the last change of each (:func:`current`): readers scan changes, not
captures.  Micro-batches overwrite their own ``batch=<id>`` folder, so a replay
adds nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from placeweave.session import checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_NEVER = -(1 << 63)
#: Rows that a task looks at together.
TOGETHER = 1 << 18


def two_newest(rows: pa.Table) -> pa.Table:
    """Of ``(_key, _at, _tie, _value)`` the two newest rows of each key; of
    repeated deliveries the first."""
    try:
        key, tie = (pc.dictionary_encode(rows[c].combine_chunks(), null_encoding="encode") for c in ("_key", "_tie"))
        key, tie = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (key, tie))
        at = pc.fill_null(rows["_at"], _NEVER)
        order = pc.sort_indices(pa.table({"key": key, "at": at, "tie": rows["_tie"]}), null_placement="at_end",
                                sort_keys=[("key", "ascending"), ("at", "descending"), ("tie", "descending")]).to_numpy()
    except pa.ArrowNotImplementedError:                      # kinds that Arrow has no order for
        return rows
    key, at, tie = key[order], at.to_numpy()[order], tie[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (at[1:] != at[:-1]) | (tie[1:] != tie[:-1])]
    order, key = order[fresh], key[fresh]
    third = np.r_[False, False, key[2:] == key[:-2]][:len(key)]
    return rows.take(pa.array(np.sort(order[~third])))


def _two_newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= TOGETHER:
            yield from two_newest(pa.Table.from_batches(held)).to_batches()
            held, n = [], 0
    if n:
        yield from two_newest(pa.Table.from_batches(held)).to_batches()


class _Newest(StatefulProcessor):
    """Rows ``(_key, _at, _tie, _value)`` → changes of the key's two newest."""

    def __init__(self, schema: str) -> None:
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.state.get()                             # None for a key never seen
        two = [] if held is None else [x for x in ((held[0], held[1], held[2]), (held[3], held[4], held[5])) if x[0] is not None]
        seq, before = (0 if held is None else held[6]), list(two)
        for r in rows:
            new = (_NEVER if r["_at"] is None else r["_at"], r["_tie"], r["_value"])
            if any(x[:2] == new[:2] for x in two):
                continue                                     # a repeated delivery
            two = sorted([*two, new], key=lambda x: (x[0], x[1] is not None, x[1]), reverse=True)[:2]
        if two == before:
            return
        (a, b, c), (d, e, f) = two[0], two[1] if len(two) > 1 else (None, None, None)
        self.state.update((a, b, c, d, e, f, seq + 1))
        yield Row(_key=key[0], _at=None if a == _NEVER else a, _tie=b, _value=c, _previous=f, _known=len(two), _seq=seq + 1)

    def close(self) -> None:
        pass


def start_changes(spark: SparkSession, source_dir: str, schema: str, sink_dir: str, key: str, event_time: str, tiebreak: str,
                  value: str, checkpoint: str | None = None, available_now: bool = True, max_files: int | None = None,
                  file_format: str = "parquet"):
    """Start the feed; returns the ``StreamingQuery``.

    Rows land in ``source_dir``; changes go to ``sink_dir`` as ``(key,
    latest_<tiebreak>, latest_<event_time>, latest_<value>, previous_<value>,
    changed, seq)``.  A row without an event time is older than any other; rows
    without a key are a key of their own.  ``max_files`` bounds the new files
    of one micro-batch."""
    if spark.conf.get(_PROVIDER, None) != ROCKSDB:
        spark.conf.set(_PROVIDER, ROCKSDB)                   # keyed state needs it
    kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schema)}
    reader = spark.readStream.schema(schema).format(file_format)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.load(source_dir).select(
        F.col(key).alias("_key"), F.unix_micros(F.col(event_time).cast("timestamp")).alias("_at"),
        F.col(tiebreak).alias("_tie"), F.col(value).alias("_value"))
    entry = "{0}_at long, {0}_tie %s, {0}_value %s" % (kinds[tiebreak], kinds[value])
    state = f"{entry.format('a')}, {entry.format('b')}, seq long"
    out = f"_key {kinds[key]}, _at long, _tie {kinds[tiebreak]}, _value {kinds[value]}, _previous {kinds[value]}, _known int, _seq long"
    newest = rows.mapInArrow(_two_newest, rows.schema)
    changes = newest.groupBy("_key").transformWithState(_Newest(state), out, "Update", "None")

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.select(
            F.col("_key").alias(key), F.col("_tie").alias(f"latest_{tiebreak}"), F.timestamp_micros("_at").alias(f"latest_{event_time}"),
            F.col("_value").alias(f"latest_{value}"), F.col("_previous").alias(f"previous_{value}"),
            F.when(F.col("_known") > 1, ~F.col("_value").eqNullSafe(F.col("_previous"))).alias("changed"), F.col("_seq").alias("seq"))
         .write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch={batch_id}"))

    path = checkpoint or f"{checkpoint_dir(spark)}/placeweave-stream/changes-{zlib.crc32(sink_dir.rstrip('/').encode()):08x}"
    writer = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def current(spark: SparkSession, sink_dir: str, key: str) -> DataFrame:
    """The last change of every key: what the newest captures say now.  A
    partial aggregate; no window, and a key's changes never meet as rows."""
    rows = spark.read.parquet(sink_dir).drop("batch")
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("_last"))
    return last.select(key, *[F.col(f"_last.{c}").alias(c) for c in rest])
