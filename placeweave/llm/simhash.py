"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits; bit ``b`` is 1 if it is set in over half of the
hashes of a text's word shingles.  Two fingerprints are linked if at most
``distance`` bits differ, and links make components.

Finding links without comparing all pairs: the 64 bits are cut into ``BLOCKS``
blocks.  Fingerprints that differ in at most d bits differ in at most d blocks,
so they agree on all bits of some choice of ``BLOCKS - d`` blocks: joining on
each such choice meets every link, and a meeting is kept only after the bits
are counted.  Distinct fingerprints take part, never documents, so copies
cost nothing here.

A choice of blocks that very many fingerprints share (near copies of one long
text) is split once more: its remaining bits are cut into blocks of
``FINE_BITS`` bits, of which again all but d agree.  Such a group leaves
d * ``FINE_BITS`` bits open, so it can hold at most 4096 fingerprints for
d = 3 — a bound that does not depend on the data.
Inside a group only the edges of a spanning forest are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeweave.llm.common import fresh, row_key, text_bytes, written
from placeweave.llm.components import components

SHINGLE, DISTANCE, SEED = 3, 3, 42
BLOCKS, FINE_BITS = 6, 4
#: Groups above this many fingerprints are split by the fine blocks.
LARGE_GROUP = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text (0 if it has no word).

    A-Z are lower-cased, words are cut at ASCII white space, shingles are
    joined by one space and counted with their repeats; a shorter text is one
    shingle."""
    words = text_bytes(text).lower().split()     # bytes.lower() maps A-Z only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = np.r_[0, ends[:-1] + 1][:n].tolist()
    last = ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at:at + 8192], last[at:at + 8192])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(values.view(np.int64))],
                names=["doc_id", "row_key", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, row_key, fp)`` for every row; ``fp`` as a signed LONG."""
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text"))
    rows = rows.withColumn("row_key", row_key())
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, row_key long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cut(positions: list[int], parts: int) -> list[int]:
    """Bit positions cut into ``parts`` blocks, as masks."""
    return [sum(1 << p for p in block) for block in np.array_split(np.array(positions, dtype=object), parts)]


def block_masks(distance: int, blocks: int = BLOCKS) -> list[int]:
    """One mask per choice of ``blocks - distance`` blocks."""
    if not 0 <= distance < blocks <= 64:
        raise ValueError("there must be more blocks than differing bits")
    cut = _cut(list(range(64)), blocks)
    return [sum(choice) for choice in combinations(cut, blocks - distance)]


def fine_masks(mask: int, distance: int) -> list[int]:
    """The masks that split the group of ``mask`` once more."""
    rest = [p for p in range(64) if not mask >> p & 1]
    cut = _cut(rest, max(distance + 1, -(-len(rest) // FINE_BITS)))
    return [mask | sum(choice) for choice in combinations(cut, len(cut) - distance)]


def _forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct ``values``."""
    out, left = [], values
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found = left[near]
                out.extend((int(at), int(x)) for x in found)
                queue.extend(found)
                left = left[~near]
    return out


def _links(distance: int):
    """Sorted ``(mask, key, fp)`` rows → links.  A group may span batches."""
    def edges(group: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[cut, len(group)])
        pair = cut[size == 2]                      # most groups, at once
        a, b = fp[pair], fp[pair + 1]
        near = np.bitwise_count(a ^ b) <= distance
        out.extend(zip(a[near].tolist(), b[near].tolist()))
        for start, n in zip(cut[size > 2], size[size > 2]):
            out.extend(_forest(fp[start:start + n], distance))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((3, 0), np.int64)
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def emit(rows: np.ndarray):
            change = np.r_[False, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]
            found = edges(np.cumsum(change), rows[2].view(np.uint64))
            flat = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], schema=schema)

        for batch in batches:
            new = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            rows = np.concatenate([held, new], axis=1)
            if not rows.shape[1]:
                continue
            tail = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
            start = int(np.flatnonzero(tail)[0])
            if start:
                yield emit(np.ascontiguousarray(rows[:, :start]))
            held = np.ascontiguousarray(rows[:, start:])
        if held.shape[1]:
            yield emit(held)
    return run


def links(spark: SparkSession, fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``fps(fp)``, distinct → edges ``(u, v)`` that connect exactly the
    fingerprints which chains of links connect."""
    masks = block_masks(distance)
    each = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                     for i, m in enumerate(masks)])
    rows = fps.select("fp", F.inline(each))
    large = (rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE_GROUP)
             .select(F.col("mask").alias("l_mask"), F.col("key").alias("l_key")))
    large = written(large, "simhash-large")
    marked = rows.join(large, (F.col("mask") == F.col("l_mask")) & (F.col("key") == F.col("l_key")), "left")
    fine, number = [], len(masks)
    for i, m in enumerate(masks):
        for f in fine_masks(m, distance):
            fine.append(f"named_struct('of', {i}, 'number', {number}, 'bits', {_signed(f)}L)".replace(
                "-9223372036854775808L", "bigint('-9223372036854775808')"))
            number += 1
    # a fixed table of masks: one row per way to split a large group
    split = spark.range(1).select(F.inline(F.expr(f"array({', '.join(fine)})")))
    again = (marked.where("l_mask is not null").join(F.broadcast(split), F.col("mask") == F.col("of"))
             .select(F.col("number").alias("mask"), F.col("fp").bitwiseAND(F.col("bits")).alias("key"), "fp"))
    groups = marked.where("l_mask is null").select("mask", "key", "fp").unionByName(again)
    ordered = groups.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return ordered.mapInArrow(_links(distance), "u long, v long").distinct()


def _in_components(docs: DataFrame, shingle: int, distance: int, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, row_key, fp, component_id, root)``; ``root`` is a fingerprint
    that names the component, whatever ids its rows have."""
    rows = written(fingerprints(docs, shingle, doc_id, text), "simhash-rows")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-fps")
    star = components(links(docs.sparkSession, fps.select("fp"), distance))
    # signed order of the nodes only names the component; the id is a minimum
    member = star.unionByName(star.select("v").distinct().select(F.col("v").alias("u"), "v"))
    grouped = fps.join(member, F.col("fp") == F.col("u"))
    least = grouped.groupBy(F.col("v").alias("of")).agg(F.min("first_doc").alias("component"))
    of_fp = grouped.join(least, F.col("v") == F.col("of")).select(F.col("fp").alias("g_fp"), "component", "v")
    look = (fps.join(of_fp, F.col("fp") == F.col("g_fp"), "left")
            .select(F.col("fp").alias("l_fp"),
                    F.when(F.col("g_fp").isNotNull(), F.col("component")).otherwise(F.col("first_doc")).alias("component_id"),
                    F.coalesce("v", "fp").alias("root")))
    return rows.join(look, F.col("fp") == F.col("l_fp")).drop("l_fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, row_key, fp, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach, the row's own
    included (null ids are no candidates; a component of null ids only has a
    null component).  Texts without words have fingerprint zero and link like
    any other.  Repeated rows all appear.  An empty table gives no rows; other
    columns are not read.
    """
    return _in_components(docs, shingle, distance, doc_id, text).drop("root")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept: of each component the one with the
    smallest doc_id (several rows of that id: the one with the smallest text
    hash; a component of null ids: likewise).  An id whose texts are in two
    components is kept once in each."""
    found = _in_components(docs, shingle, distance, doc_id, text)
    keep = (found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("root").agg(F.min(F.struct("row_key", "doc_id")).alias("k"), F.count(F.lit(1)).alias("n")))
    k_id, k_key, k_n, k_row = fresh(docs, "keep_id", "keep_key", "keep_n", "keep_row")
    keep = keep.select(F.col("k.doc_id").alias(k_id), F.col("k.row_key").alias(k_key), F.col("n").alias(k_n))
    d, t = docs[f"`{doc_id}`"], docs[f"`{text}`"]
    rows = docs.join(keep, d.cast("long").eqNullSafe(keep[k_id]) & (F.xxhash64(d.cast("long"), t) == keep[k_key]))
    once = rows.where(F.col(k_n) == 1)
    # rows that differ in other columns only: the smallest hash of the whole row
    whole = F.xxhash64(*[docs[f"`{c}`"] for c, kind in docs.dtypes if not kind.startswith("map")])
    again = rows.where(F.col(k_n) > 1).withColumn(k_row, whole)
    first = F.row_number().over(Window.partitionBy(k_id, k_key).orderBy(k_row))
    again = again.withColumn(k_row, first).where(F.col(k_row) == 1).drop(k_row)
    return once.unionByName(again).drop(k_id, k_key, k_n)
