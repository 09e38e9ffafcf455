"""Benchmark decontamination by pigeonhole edit matching.

A test item of m folded characters may appear with up to ``m * ERROR_RATE``
edits.  Cut into that many pieces plus one, at least one piece of an
occurrence is untouched, so exact piece hits find every occurrence; each hit
is verified with Myers' bit-parallel distance over the text around it.

The test items are the stated query set: they go to the tasks in blocks of at
most ``BLOCK_CHARS`` characters (more items, more passes), every document
meets every block, and documents are never shuffled.  Folding: lower case,
white space runs become one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import map_rows, row_key

ERROR_RATE = 0.05
BLOCK_CHARS = 4_000_000


def fold(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` consecutive pieces of an item with their offsets."""
    n = min(errors + 1, len(item))
    cut = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(item_masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(smallest edit distance of the item to any stretch of ``text``, end of
    the first such stretch); one step of whole-word bit operations per
    character."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = item_masks.get(c, 0)
        vertical = eq | down
        across = ((eq & up) + up ^ up) | eq
        plus = down | ~(across | up) & full
        minus = up & across
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
            if score < best:
                best, end = score, at
        plus, minus = plus << 1 & full, minus << 1 & full
        up = minus | ~(vertical | plus) & full
        down = plus & vertical
    return best, end


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float) -> None:
        self.items = [(i, t, int(len(t) * error_rate)) for i, t in items if t]
        self.masks = [masks(t) for _, t, _ in self.items]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces(text, errors):
                where.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item number, distance, end in the folded text) of the best
        occurrence of each item that is within its errors."""
        folded = fold(text)
        if not folded or not self.items:
            return []
        starts: dict[int, set[int]] = {}
        for last, (n, places) in self.automaton.iter(folded):
            for k, offset in places:
                starts.setdefault(k, set()).add(last + 1 - n - offset)
        out = []
        for k, found in starts.items():
            hit = self._verify(k, sorted(found), folded)
            if hit:
                out.append((k, *hit))
        return out

    def _verify(self, k: int, found: list[int], folded: str) -> tuple[int, int] | None:
        _, item, errors = self.items[k]
        for start in found:
            if start >= 0 and folded.startswith(item, start):
                return 0, start + len(item)
        best = None
        at = 0
        while errors and at < len(found):     # hits nearby share one window
            first = last = found[at]
            while at < len(found) and found[at] <= last + errors:
                last = found[at]
                at += 1
            low = max(0, first - errors)
            distance, end = myers(self.masks[k], len(item), folded[low:last + len(item) + errors])
            if distance <= errors and (best is None or distance < best[0]):
                best = distance, low + end
        return best


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    size = 0
    rows = items.select(items[f"`{item_id}`"].alias("i"), items[f"`{text}`"].alias("t")).where("t is not null")
    for i, t in rows.orderBy("i", "t").toLocalIterator():
        folded = fold(t)
        if block and size + len(folded) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((i, folded))
        size += len(folded)
    yield block


def matches(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, doc_id: str = "doc_id",
            text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, row_key, item_id, distance, end)``: one row for each row of
    ``docs`` and item found in it, with the smallest distance and where that
    occurrence ends in the folded text.

    Null and empty texts match nothing, items with a null or empty text are
    found nowhere; an item with a null id is searched like any other and
    reported with that null id; items shorter than ``1 / error_rate`` must match exactly.
    Repeated rows and repeated items each have their own result rows.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text"))
    rows = rows.withColumn("row_key", row_key())

    def search(block):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, error_rate)
            for batch in batches:
                out = [(i, key, matcher.items[k][0], distance, end)
                       for i, key, t in zip(batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist(),
                                            batch.column("text").to_pylist())
                       for k, distance, end in matcher.find(t)]
                cols = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                    names=["doc_id", "row_key", "item_id", "distance", "end"])
        return rows.mapInArrow(run, "doc_id long, row_key long, item_id long, distance int, end int")

    return reduce(DataFrame.unionByName, [search(b) for b in _blocks(items, item_id, item_text)])


def clean(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, text: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all columns; a
    filter inside the scan, no shuffle."""
    spark = docs.sparkSession
    out, at = docs, docs.columns.index(text)
    for block in _blocks(items, item_id, item_text):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at=at) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, error_rate)
            for batch in batches:
                keep = [not matcher.find(t) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))
        out = map_rows(out, run)
    return out
