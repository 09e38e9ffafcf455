"""Substring removal by fixed-block anchors.

A word is removed if a window of ``window`` consecutive words that covers it
also starts in a document with a smaller id.

1. Every document's non-overlapping blocks of ``window // 2`` words are the
   index; any window of it contains a whole block.  All rolling windows of
   that length of all documents probe the index.
2. A hit is extended both ways: every full window that contains it is a
   candidate, on both sides.  Candidates meet by the hash of all their words
   (80 bits); the smallest id that has a window keeps it, the others lose it.
3. Runs of lost windows are the maximal repeats; their words go.

Each step moves packed records by hash bucket (see ``packed``).  Of a block
that many documents share, a task sends the smallest document only, so index
buckets hold little more than distinct hashes; probes pass by them in a
stream.  Before step 2 meets, a task gives its own later copies of a window
away, so a passage that very many documents share sends one record per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import bucket_count, estimate_bytes, merged, runs, written
from placeweave.llm.packed import (SCHEMA, Rolling, batch_of, chunks, gaps, number_rows, pack, second_rolling, split,
                                   texts_with_records, to_docs, unpack, with_texts)

WINDOW = 50
#: Probes, and candidate windows, of one hash bucket (about).
PROBES_PER_BUCKET, WINDOWS_PER_BUCKET = 8_000_000, 1_000_000
#: Texts of one document bucket (bytes, about).
TEXT_PER_BUCKET = 32 << 20
INDEX, PROBE, CANDIDATE, LOST, MEET = 1, 0, 2, 3, 4
#: Windows that a task collects before it packs them.
_FLUSH = 2_000_000


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _of_least(low: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The entries of each hash's smallest document, in order.  Only those are
    needed as an index: every other document that has the block probes it,
    meets a smaller id and is a candidate by that."""
    order = np.lexsort((doc, low))
    new = np.r_[True, low[order][1:] != low[order][:-1]]
    least = doc[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    keep = np.empty(len(low), bool)
    keep[order] = doc[order] == least
    return np.flatnonzero(keep)


def _probe(block: int, n: int):
    """Documents → index blocks and rolling windows by hash bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling()
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            h, doc, twin, pos = (np.concatenate(c) for c in zip(*held))
            held.clear()
            bucket = (h >> np.uint64(32)) % np.uint64(n)
            low = h.astype(np.uint32)
            rows = []
            for b, at in split(bucket.astype(np.int64), n):
                rows.append((b, PROBE, pack(low[at], gaps(doc[at]), twin[at], pos[at])))
                at = at[pos[at] % block == 0]
                if len(at):
                    at = at[_of_least(low[at], doc[at])]
                    rows.append((b, INDEX, pack(low[at], gaps(doc[at]), twin[at], pos[at])))
            return batch_of(rows)

        for chunk in chunks(batches):
            for doc, twin, data in chunk:
                words = data.split() if doc is not None else []
                if len(words) < 2 * block - 1:
                    continue
                h = roll.windows(roll.sums(_hashes(words)), block)
                held.append((h, np.full(len(h), doc, np.int64), np.full(len(h), twin, np.int32),
                             np.arange(len(h), dtype=np.int32)))
            if sum(len(x[0]) for x in held) >= _FLUSH:
                yield flush()
        if held:
            yield flush()
    return run


class _Index:
    """The index blocks of one bucket: smallest id per hash, and the largest
    id that probed it."""

    def __init__(self, blobs: list[list[np.ndarray]]) -> None:
        low, doc, twin, pos = [np.concatenate(c) for c in zip(*blobs)] if blobs else [np.empty(0, np.int64)] * 4
        if len(low):
            at = _of_least(low, doc)
            low, doc, twin, pos = low[at], doc[at], twin[at], pos[at]
        order = np.lexsort((doc, low))
        self.low, self.doc, self.twin, self.pos = low[order], doc[order], twin[order], pos[order]
        first = np.flatnonzero(np.r_[True, self.low[1:] != self.low[:-1]]) if len(low) else np.empty(0, np.int64)
        self.keys, self.least = self.low[first], self.doc[first]
        self.number = np.cumsum(np.r_[True, self.low[1:] != self.low[:-1]]) - 1 if len(low) else first
        self.most = np.full(len(self.keys), np.iinfo(np.int64).min)

    def probe(self, low: np.ndarray, doc: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(low), bool)
        at = np.minimum(np.searchsorted(self.keys, low), len(self.keys) - 1)
        same = self.keys[at] == low
        np.maximum.at(self.most, at[same], doc[same])
        return same & (self.least[at] < doc)

    def sources(self) -> tuple[np.ndarray, ...]:
        live = self.most[self.number] > self.doc if len(self.keys) else np.zeros(0, bool)
        return self.doc[live], self.twin[live], self.pos[live]


def _hit(n_docs: int):
    """Index and probes, by bucket → candidates, by document bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs, index = None, [], None
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            doc, twin, pos = (np.concatenate(c) for c in zip(*held))
            held.clear()
            return batch_of(to_docs(CANDIDATE, n_docs, doc, twin, pos))

        for batch in batches:
            for b, kind, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "data"))):
                if b != bucket:
                    if index is not None:
                        held.append(index.sources())
                    bucket, blobs, index = b, [], None
                low, doc, twin, pos = unpack(data)
                doc = np.cumsum(doc)
                if kind == INDEX:
                    blobs.append([low, doc, twin, pos])
                    continue
                if index is None:
                    index, blobs = _Index(blobs), []
                hit = index.probe(low, doc)
                held.append((doc[hit], twin[hit], pos[hit]))
                if sum(len(x[0]) for x in held) >= _FLUSH:
                    yield flush()
        if index is not None:
            held.append(index.sources())
        if held:
            yield flush()
    return run


def _candidates(window: int, block: int, n: int, n_docs: int):
    """Texts with their hits → all windows around the hits, by hash bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Rolling(), second_rolling()
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            h, g, doc, twin, start = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((doc, g, h))
            h, g, doc, twin, start = h[order], g[order], doc[order], twin[order], start[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            late = doc > doc[first]                   # this task knows a smaller id
            rows = [(b, LOST, data) for b, _, data in _lost(doc[late], twin[late], start[late], n_docs)]
            # the smallest id's windows stand for this task
            stay = np.flatnonzero(~late)
            stay = stay[np.argsort(doc[stay], kind="stable")]
            for b, at in split((h[stay] % np.uint64(n)).astype(np.int64), n):
                at = stay[at]
                rows.append((b, MEET, pack(h[at], g[at], gaps(doc[at]), twin[at], start[at])))
            return batch_of(rows)

        for doc, twin, data, found in texts_with_records(batches, {CANDIDATE}):
            if found[CANDIDATE] is None or data is None:
                continue
            words = data.split()
            last = len(words) - window
            if last < 0:
                continue
            pos = np.unique(found[CANDIDATE][0]).astype(np.int64)
            a, b = merged(np.maximum(pos - (window - block), 0), np.minimum(pos, last) + 1)
            keep = b > a
            start = np.concatenate([np.arange(x, y) for x, y in zip(a[keep], b[keep])] or [np.empty(0, np.int64)])
            hashes = _hashes(words)
            s1, s2 = one.sums(hashes), two.sums(hashes)
            held.append((one.spans(s1, start, start + window),
                         (two.spans(s2, start, start + window) >> np.uint64(48)).astype(np.uint16),
                         np.full(len(start), doc, np.int64), np.full(len(start), twin, np.int32), start.astype(np.int32)))
            if sum(len(x[0]) for x in held) >= _FLUSH // 2:
                yield flush()
        if held:
            yield flush()
    return run


def _lost(doc: np.ndarray, twin: np.ndarray, start: np.ndarray, n_docs: int) -> list[tuple[int, int, bytes]]:
    """Lost window starts as runs, by document bucket."""
    if not len(doc):
        return []
    order = np.lexsort((start, twin, doc))
    doc, twin, start = doc[order], twin[order], start[order].astype(np.int64)
    cut = np.r_[True, (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1]) | (start[1:] > start[:-1] + 1)]
    first = np.flatnonzero(cut)
    last = np.r_[first[1:] - 1, len(doc) - 1]
    return to_docs(LOST, n_docs, doc[first], twin[first], start[first].astype(np.int32),
                   (start[last] - start[first] + 1).astype(np.int32))


def _meet(n_docs: int):
    """Candidate windows of a hash bucket → the ones that a smaller id has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []

        def settle():
            h, g, doc, twin, start = (np.concatenate(c) for c in zip(*blobs))
            order = np.lexsort((doc, g, h))
            h, g, doc = h[order], g[order], doc[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
            late = doc > doc[np.flatnonzero(new)[np.cumsum(new) - 1]]
            at = order[late]
            return batch_of(_lost(doc[late], twin[at], start[at], n_docs))

        for batch in batches:
            for b, kind, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "data"))):
                if kind == LOST:                       # settled before: b is a document bucket
                    yield batch_of([(b, LOST, data)])
                    continue
                if b != bucket and blobs:
                    yield settle()
                    blobs.clear()
                bucket = b
                h, g, doc, twin, start = unpack(data)
                blobs.append([h, g, np.cumsum(doc), twin, start])
        if blobs:
            yield settle()
    return run


def _remove(window: int):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def batch():
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), kind))],
                names=["doc_id", "twin", "n_words", "n_removed", "kept", "spans"])

        for doc, twin, data, found in texts_with_records(batches, {LOST}):
            words = (data or b"").split()
            spans, removed, kept = [], 0, words
            if found[LOST] is not None:
                start, length = (x.astype(np.int64) for x in found[LOST])
                a, b = merged(start, start + length - 1 + window)
                keep = np.ones(len(words), bool)
                for x, y in zip(a.tolist(), b.tolist()):
                    keep[x:y] = False
                    spans.append({"start": x, "end": y})
                removed = int((~keep).sum())
                kept = [w for w, k in zip(words, keep.tolist()) if k]
            text = b" ".join(kept).decode("utf-8", "surrogatepass")
            out.append((doc, twin, len(words), removed, text, spans))
            size += len(text) + 64
            if size > 8 << 20:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, twin, n_words, n_removed, kept, spans)`` for every row of
    ``docs``: ``kept`` is the remaining words joined by one space, ``spans``
    the removed stretches (``start`` to ``end``, in words, ``end`` excluded).

    Null texts have no words.  Rows without an id neither give nor lose words.
    Rows of the same id do not count as earlier copies of each other.  Texts
    shorter than a window stay whole; an empty table gives no rows; other
    columns are not read.
    """
    if window < 3:
        raise ValueError("a window has at least three words")
    spark, block = docs.sparkSession, window // 2
    size = estimate_bytes(docs, text)
    n = bucket_count(spark, size // 6, PROBES_PER_BUCKET)
    n_meet = bucket_count(spark, size // 6, WINDOWS_PER_BUCKET * 2)
    n_docs = bucket_count(spark, size, TEXT_PER_BUCKET)
    rows = number_rows(docs, doc_id, text)
    probes = (rows.mapInArrow(_probe(block, n), SCHEMA).repartition("bucket")
              .sortWithinPartitions("bucket", F.col("kind").desc()))
    hits = written(probes.mapInArrow(_hit(n_docs), SCHEMA), "substring-hits")
    windows = with_texts(rows, hits, n_docs).mapInArrow(_candidates(window, block, n_meet, n_docs), SCHEMA)
    lost = windows.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_meet(n_docs), SCHEMA)
    lost = written(lost, "substring-lost")
    return with_texts(rows, lost, n_docs).mapInArrow(
        _remove(window), "doc_id long, twin int, n_words long, n_removed long, kept string, "
                         "spans array<struct<start:int,end:int>>")
