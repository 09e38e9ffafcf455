"""Exact byte-level repeats by two-stage suffix sorting.

A byte is removed if a string of ``width`` bytes that covers it also starts in
a document with a smaller id.

A suffix array of the whole corpus would belong to one machine, so the
suffixes are first dealt out such that equal strings meet: each string of
``width`` bytes belongs to the smallest hash among its grams of ``GRAM``
bytes, its anchor.  Neighbouring strings mostly share an anchor and travel as
one segment.

1. Segments meet by anchor, as hashes.  Equal segments need no sorting: all
   but the smallest id's are removed.  An anchor with one segment only is done.
2. Segments of other anchors send their bytes.  Their suffixes are sorted in
   two stages: only those smaller than their successor are compared directly;
   the rest follow from their successors in one scan over the buckets of first
   bytes.  Neighbours in the order whose common prefix reaches ``width`` hold
   the same string, and the smallest id among them keeps it.
3. The removed strings of each document are merged and cut out.

An anchor whose different segments hold more than ``HOT_BYTES`` (a passage that
very many documents share amid different surroundings) would be one group in
one task.  Anchors are counted first, in hashed cells; segments of a cell above
the bound are dealt out string by string, by the hash of all ``width`` bytes, so
no group outgrows the records that its tasks send: one per string.

Records are packed by hash bucket (see ``packed``).  A task gives its own
later copies of a segment away before it sends anything, so a passage that
very many documents share costs one record per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import bucket_count, estimate_bytes, merged, mix64, runs, written
from placeweave.llm.packed import (SCHEMA, Rolling, batch_of, chunks, gaps, number_rows, pack, split, texts_with_records,
                                   second_rolling, to_docs, unpack, with_texts)

WIDTH, GRAM = 50, 20
#: Segments, and segment bytes that are sorted together, per bucket (about).
SEGMENTS_PER_BUCKET, SORTED_BYTES = 500_000, 8 << 20
TEXT_PER_BUCKET = 32 << 20
#: Bytes of different segments above which a cell of anchors is dealt out by string.
HOT_BYTES = SORTED_BYTES
REQUEST, LOST, SEGMENT = 1, 2, 3
_CHUNK, _FLUSH = 512 << 10, 1_000_000
_CONTENT = np.uint64(16)


def sliding_min(h: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` neighbours, by doubling."""
    m, have = h, 1
    while have * 2 <= span:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[:len(h) - span + 1], m[span - have:span - have + len(h) - span + 1])


def segments(data: np.ndarray, ends: np.ndarray, roll: Rolling, byte_hash: np.ndarray, width: int, gram: int):
    """(first, strings, anchor, content) of all segments of concatenated
    texts that end at ``ends``."""
    n = len(data)
    if n < width:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    sums = roll.sums(byte_hash[data])
    low = sliding_min(roll.windows(sums, gram), width - gram + 1)
    whole = np.ones(n - width + 1, bool)              # no string crosses texts
    for e in ends[:-1].tolist():
        whole[max(0, e - width + 1):e] = False
    new = np.r_[True, low[1:] != low[:-1]]
    new[1:] |= ~whole[:-1]
    first = np.flatnonzero(new & whole)
    stop = np.flatnonzero(np.r_[new[1:] | ~whole[1:], True] & whole) + 1
    content = roll.spans(sums, first, stop + width - 1)
    return first, stop - first, mix64(low[first]), mix64(content ^ (stop - first).astype(np.uint64))


def _lost(doc, twin, first, n, n_docs):
    return to_docs(LOST, n_docs, doc, twin, first.astype(np.int32), n.astype(np.int32))


def _settle(anchor, content, doc):
    """Order, and in that order: which segments a smaller id has too, and
    which belong to an anchor with several contents."""
    order = np.lexsort((doc, content, anchor))
    a, c, d = anchor[order], content[order], doc[order]
    new_a = np.r_[True, a[1:] != a[:-1]]
    new = new_a | np.r_[True, c[1:] != c[:-1]]
    late = d > d[np.flatnonzero(new)[np.cumsum(new) - 1]]
    group = np.cumsum(new_a) - 1
    several = np.bincount(group, new)[group] > 1
    return order, late, several


def _byte_hash() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _cell(anchor: np.ndarray, cells: int) -> np.ndarray:
    return (anchor % np.uint64(cells)).astype(np.int64)


def _weigh(width: int, gram: int, cells: int):
    """Documents → bytes of different segments per cell of anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, byte_hash = Rolling(), _byte_hash()
        total = np.zeros(cells, np.int64)
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            anchor, content, count = (np.concatenate(c) for c in zip(*held))
            held.clear()
            _, one = np.unique(content, return_index=True)
            np.add.at(total, _cell(anchor[one], cells), count[one] + (width - 1))

        for chunk in chunks(batches, _CHUNK):
            texts = [x[2] for x in chunk if x[0] is not None and len(x[2]) >= width]
            if not texts:
                continue
            _, count, anchor, content = segments(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]),
                                                 roll, byte_hash, width, gram)
            held.append((anchor, content, count))
            if sum(len(x[0]) for x in held) >= _FLUSH:
                flush()
        if held:
            flush()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])
    return run


def hot_cells(rows: DataFrame, width: int, gram: int, cells: int) -> np.ndarray:
    """Cells above ``HOT_BYTES``: at most the corpus's segment bytes divided
    by that bound reach the driver."""
    weighed = rows.mapInArrow(_weigh(width, gram, cells), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return np.array([r["cell"] for r in weighed.where(F.col("n") > HOT_BYTES).select("cell").collect()], np.int64)


def _segments(width: int, gram: int, n: int, n_docs: int, cells: int, hot: np.ndarray):
    """Documents → segments by anchor bucket; segments of the hot cells as
    single strings, whose anchor and content are hashes of the string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, other, byte_hash = Rolling(), second_rolling(), _byte_hash()
        is_hot = np.zeros(cells, bool)
        is_hot[hot] = True
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            anchor, content, doc, twin, first, count = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order, late, _ = _settle(anchor, content, doc)
            gone = order[late]
            rows = _lost(doc[gone], twin[gone], first[gone], count[gone], n_docs)
            stay = order[~late]
            stay = stay[np.argsort(doc[stay], kind="stable")]
            for b, at in split(((anchor[stay] >> np.uint64(40)) % np.uint64(n)).astype(np.int64), n):
                at = stay[at]
                rows.append((b, SEGMENT, pack(anchor[at], content[at] >> _CONTENT, gaps(doc[at]), twin[at], first[at], count[at])))
            return batch_of(rows)

        for chunk in chunks(batches, _CHUNK):
            chunk = [x for x in chunk if x[0] is not None and len(x[2]) >= width]
            if not chunk:
                continue
            ends = np.cumsum([len(x[2]) for x in chunk])
            flat = np.frombuffer(b"".join(x[2] for x in chunk), np.uint8)
            first, count, anchor, content = segments(flat, ends, roll, byte_hash, width, gram)
            apart = is_hot[_cell(anchor, cells)]
            if apart.any():
                at = _ranges(first[apart], count[apart])
                name, check = (mix64(r.spans(r.sums(byte_hash[flat]), at, at + width)) for r in (roll, other))
                first, count = np.r_[first[~apart], at], np.r_[count[~apart], np.ones(len(at), np.int64)]
                anchor, content = np.r_[anchor[~apart], name], np.r_[content[~apart], check]
            which = np.searchsorted(ends, first, "right")
            doc = np.array([x[0] for x in chunk], np.int64)[which]
            twin = np.array([x[1] for x in chunk], np.int32)[which]
            start = np.r_[0, ends[:-1]][which]
            held.append((anchor, content, doc, twin, (first - start).astype(np.int32), count.astype(np.int32)))
            if sum(len(x[0]) for x in held) >= _FLUSH:
                yield flush()
        if held:
            yield flush()
    return run


def _meet(n_docs: int):
    """Segments of an anchor bucket → lost ones, and requests for bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []

        def settle():
            anchor, content, doc, twin, first, count = (np.concatenate(c) for c in zip(*blobs))
            order, late, several = _settle(anchor, content, doc)
            gone, ask = order[late], order[~late & several]
            return batch_of(_lost(doc[gone], twin[gone], first[gone], count[gone], n_docs)
                            + to_docs(REQUEST, n_docs, doc[ask], twin[ask], first[ask], count[ask], anchor[ask]))

        for batch in batches:
            for b, kind, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "data"))):
                if kind == LOST:
                    yield batch_of([(b, LOST, data)])
                    continue
                if b != bucket and blobs:
                    yield settle()
                    blobs.clear()
                bucket = b
                anchor, content, doc, *rest = unpack(data)
                blobs.append([anchor, content, np.cumsum(doc), *rest])
        if blobs:
            yield settle()
    return run


def _cut_out(width: int, n: int):
    """Texts with requests → segment bytes by anchor bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush():
            anchor, doc, twin, first, count, length = (np.concatenate(c) for c in list(zip(*held))[:6])
            flat = np.concatenate([x[6] for x in held])
            held.clear()
            begin = np.cumsum(length) - length
            rows = []
            for b, at in split(((anchor >> np.uint64(20)) % np.uint64(n)).astype(np.int64), n):
                index = _ranges(begin[at], length[at])
                head = pack(anchor[at], gaps(doc[at]), twin[at], first[at], count[at])
                rows.append((b, SEGMENT, len(head).to_bytes(8, "little") + head + pack(flat[index])))
            return batch_of(rows)

        for doc, twin, data, found in texts_with_records(batches, {REQUEST}):
            if found[REQUEST] is None or data is None:
                continue
            first, count, anchor = found[REQUEST]
            length = count.astype(np.int64) + width - 1
            flat = np.frombuffer(data, np.uint8)[_ranges(first.astype(np.int64), length)]
            m = len(first)
            held.append((anchor, np.full(m, doc, np.int64), np.full(m, twin, np.int32), first, count, length, flat))
            size += len(flat)
            if size >= 16 << 20:
                yield flush()
                size = 0
        if held:
            yield flush()
    return run


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, … of all ranges, one after the other."""
    shift = start - (np.cumsum(length) - length)
    return np.repeat(shift, length) + np.arange(int(length.sum()))


def _word(text: np.ndarray, at: np.ndarray, offset: int) -> np.ndarray:
    """Eight bytes of each suffix as one number that compares like them."""
    return np.lib.stride_tricks.sliding_window_view(text, 8)[at + offset].view(">u8").ravel().astype(np.uint64)


def _offsets(width: int) -> list[int]:
    return [*range(0, width - 8, 8), width - 8]


def direct_sort(text: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Suffixes in the order of their first ``width`` bytes: by eight bytes,
    then only among equals by the next eight."""
    order = at[np.argsort(_word(text, at, 0), kind="stable")]
    word = _word(text, order, 0)
    group = np.cumsum(np.r_[True, word[1:] != word[:-1]]) if len(order) else np.empty(0, np.int64)
    for offset in _offsets(width)[1:]:
        if not len(order):
            break
        tied = np.r_[group[1:] == group[:-1], False]
        tied[1:] |= tied[:-1].copy()
        where = np.flatnonzero(tied)
        if not len(where):
            break
        part = order[where]
        word = _word(text, part, offset)
        by = np.lexsort((word, group[where]))
        order[where], word = part[by], word[by]
        new = np.ones(len(order), bool)
        new[1:] = group[1:] != group[:-1]
        g = group[where]
        new[where[1:]] |= (word[1:] != word[:-1]) & (g[1:] == g[:-1])
        group = np.cumsum(new)
    return order


def two_stage_sort(text: np.ndarray, wanted: np.ndarray, width: int) -> np.ndarray:
    """The ``wanted`` suffixes (positions, marked in a mask) of ``text`` in the
    order of their first ``width`` bytes.  ``text`` ends in ``width + 8`` bytes
    of padding, none of them wanted."""
    n = len(text)
    # smaller than the successor: by the next byte that differs
    step = np.sign(text[1:].astype(np.int16) - text[:-1])
    differs = np.flatnonzero(step)
    following = np.searchsorted(differs, np.arange(n - 1))
    rising = np.zeros(n, bool)
    inside = following < len(differs)
    rising[:-1][inside] = step[differs[following[inside]]] > 0
    # successors through which a falling suffix is reached belong to the set
    needed = wanted.copy()
    fall = np.flatnonzero(wanted & ~rising)
    while len(fall):
        fall = fall[fall + 1 < n] + 1
        fall = fall[~needed[fall]]
        needed[fall] = True
        fall = fall[~rising[fall]]
    direct = direct_sort(text, np.flatnonzero(needed & rising), width) if n > width + 8 else np.flatnonzero(needed & rising)
    heads = np.searchsorted(text[direct], np.arange(257))
    coming: list[list[np.ndarray]] = [[] for _ in range(256)]
    last = np.flatnonzero(needed & ~rising)
    if len(last) and last[-1] == n - 1:               # the end of the text has no successor
        coming[int(text[-1])].append(last[-1:])
    out = []
    for c in range(256):
        falling = coming[c]
        new = np.concatenate(falling) if falling else np.empty(0, np.int64)
        while len(new):                                # runs of the byte itself
            before = new[new > 0] - 1
            new = before[(text[before] == c) & needed[before]]
            if len(new):
                falling.append(new)
        bucket = np.concatenate([*falling, direct[heads[c]:heads[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[needed[before] & (text[before] > c)]
        for b, at in split(text[before].astype(np.int64), 256):
            coming[b].append(before[at])
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    return order[wanted[order]]


def equal_neighbours(text: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """For each sorted suffix but the first: does its common prefix with the
    one before reach ``width``?"""
    same = np.ones(max(len(order) - 1, 0), bool)
    for offset in _offsets(width):
        live = np.flatnonzero(same)
        if len(live):
            same[live] = _word(text, order[live], offset) == _word(text, order[live + 1], offset)
    return same


def _sort(width: int, n_docs: int):
    """Segment bytes of an anchor bucket → strings that a smaller id has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []

        def settle():
            doc, twin, first, count = (np.concatenate(c) for c in list(zip(*blobs))[:4])
            text = np.concatenate([*(x[4] for x in blobs), np.zeros(width + 8, np.uint8)])
            length = count.astype(np.int64) + width - 1
            begin = np.cumsum(length) - length
            which = np.repeat(np.arange(len(doc)), count)
            starts = _ranges(begin, count.astype(np.int64))
            wanted = np.zeros(len(text), bool)
            wanted[starts] = True
            owner = np.zeros(len(text), np.int32)
            owner[starts] = which
            order = two_stage_sort(text, wanted, width)
            new = np.r_[True, ~equal_neighbours(text, order, width)]
            ids = doc[owner[order]]
            least = np.minimum.reduceat(ids, np.flatnonzero(new))
            late = np.sort(order[ids > least[np.cumsum(new) - 1]])
            at, n = runs(late)          # segments are width - 1 bytes apart: no run leaves one
            seg = owner[at]
            return batch_of(_lost(doc[seg], twin[seg], first[seg] + (at - begin[seg]), n, n_docs))

        for batch in batches:
            for b, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist()):
                if b != bucket and blobs:
                    yield settle()
                    blobs.clear()
                bucket = b
                head = int.from_bytes(data[:8], "little")
                _, doc, twin, first, count = unpack(data[8:8 + head])
                blobs.append([np.cumsum(doc), twin, first, count, unpack(data[8 + head:])[0]])
        if blobs:
            yield settle()
    return run


def _remove(width: int):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def batch():
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), kind))],
                names=["doc_id", "twin", "n_bytes", "n_removed", "kept", "spans"])

        for doc, twin, data, found in texts_with_records(batches, {LOST}):
            kept, data, spans = data or b"", data or b"", []
            if found[LOST] is not None:
                start, count = (x.astype(np.int64) for x in found[LOST])
                a, b = merged(start, start + count - 1 + width)
                spans = [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())]
                cuts = zip([0, *b.tolist()], [*a.tolist(), len(data)])
                kept = b"".join(data[x:y] for x, y in cuts)
            out.append((doc, twin, len(data), len(data) - len(kept), kept, spans))
            size += len(kept) + 64
            if size > 8 << 20:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()
    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, twin, n_bytes, n_removed, kept, spans)`` for every row of
    ``docs``: ``kept`` is the remaining bytes, ``spans`` the removed stretches
    (``start`` to ``end``, in bytes, ``end`` excluded, none touching another).

    Null texts count as empty.  Rows without an id neither give nor lose
    bytes.  Rows of the same id do not count as earlier copies of each other.
    Texts shorter than ``width`` stay whole; an empty table gives no rows;
    other columns are not read.
    """
    if width < 12:
        raise ValueError("a string has at least 12 bytes")
    gram = min(GRAM, width - 8)
    spark, size = docs.sparkSession, estimate_bytes(docs, text)
    n = bucket_count(spark, 2 * size // (width - gram + 2), SEGMENTS_PER_BUCKET)
    n_sort = bucket_count(spark, size // 2, SORTED_BYTES)
    n_docs = bucket_count(spark, size, TEXT_PER_BUCKET)
    cells = 1 << max(10, (64 * size // SORTED_BYTES).bit_length())     # an even cell holds a 16th of the bound
    rows = number_rows(docs, doc_id, text)
    hot = hot_cells(rows, width, gram, cells)
    met = (rows.mapInArrow(_segments(width, gram, n, n_docs, cells, hot), SCHEMA).repartition("bucket")
           .sortWithinPartitions("bucket", "kind").mapInArrow(_meet(n_docs), SCHEMA))
    met = written(met, "suffix-met")
    sent = with_texts(rows, met.where(F.col("kind") == REQUEST), n_docs).mapInArrow(_cut_out(width, n_sort), SCHEMA)
    lost = written(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sort(width, n_docs), SCHEMA), "suffix-lost")
    gone = met.where(F.col("kind") == LOST).unionByName(lost)
    return with_texts(rows, gone, n_docs).mapInArrow(
        _remove(width), "doc_id long, twin int, n_bytes long, n_removed long, kept binary, "
                        "spans array<struct<start:int,end:int>>")
