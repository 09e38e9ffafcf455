"""Packed shuffles: many small records per row.

The repeat finders move a few bytes for each position of the corpus.  As rows
of their own these would cost several times their payload, so a task packs the
records that go to one hash bucket into one binary value: columns of equal
length, ids as gaps, bytes of equal weight side by side, zstandard on top.
Spark shuffles the rows by bucket; a task of the next stage unpacks them into
numpy arrays.

Rows are named by ``(doc_id, twin)``.  ``twin`` is 0 unless an id occurs with
several texts; equal rows share a name and have the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import mix64, text_bytes, written
from placeweave.plans.analyses import group_ranks

SCHEMA = "bucket int, kind int, data binary"
#: Text bytes that a task takes up at once (a longer text is taken alone).
CHUNK_BYTES = 4 << 20
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as bytes; values of 8, 4, 2 or 1 bytes."""
    n = len(columns[0])
    head = np.array([n, len(columns)], np.int64).tobytes() + "".join(c.dtype.str[1:] for c in columns).encode()
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(n, c.dtype.itemsize).T.tobytes() for c in columns]
    return zstandard.compress(head + b"".join(planes), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n, k = np.frombuffer(raw, np.int64, 2)
    kinds = raw[16:16 + 2 * k].decode()
    at, out = 16 + 2 * int(k), []
    for i in range(0, 2 * int(k), 2):
        kind = np.dtype("<" + kinds[i:i + 2])
        size = int(n) * kind.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, int(n))
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(int(n)))
        at += size
    return out


def pack_apart(*columns: np.ndarray) -> bytes:
    """Like :func:`pack`, with the bytes of each weight compressed by themselves
    where that is shorter: next to even bytes, uneven ones share their code."""
    whole = pack(*columns)
    n = len(columns[0])
    planes = [x for c in columns for x in np.ascontiguousarray(c).view(np.uint8).reshape(n, c.dtype.itemsize).T]
    press = zstandard.ZstdCompressor(level=1)
    small = [min(x.tobytes(), press.compress(x.tobytes()), key=len) for x in planes]      # n bytes: as they are
    head = np.array([n, len(columns), *map(len, small)], np.uint32).tobytes() + "".join(c.dtype.str[1:] for c in columns).encode()
    return min(b"\0" + whole, b"\1" + b"".join((len(head).to_bytes(2, "little"), head, *small)), key=len)


def unpack_apart(data: bytes) -> list[np.ndarray]:
    if data[0] == 0:
        return unpack(data[1:])
    at = 3 + int.from_bytes(data[1:3], "little")
    n, k = np.frombuffer(data, np.uint32, 2, 3).tolist()
    sizes = iter(np.frombuffer(data, np.uint32, (at - 3 - 2 * k) // 4 - 2, 11).tolist())
    kinds, out = data[at - 2 * k:at].decode(), []
    for i in range(0, 2 * k, 2):
        kind = np.dtype("<" + kinds[i:i + 2])
        planes = np.empty((n, kind.itemsize), np.uint8)
        for j in range(kind.itemsize):
            size = next(sizes)
            raw = data[at:at + size]
            planes[:, j] = np.frombuffer(raw if size == n else zstandard.decompress(raw), np.uint8)
            at += size
        out.append(planes.view(kind).reshape(n))
    return out


def gaps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def number_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, twin, text)`` of every row.  Ids that occur with several
    texts are found by one aggregate over (id, text hash); as a rule there are
    none, and the join below is with an empty table.  The texts of an id are
    numbered over range parts, so an id may have any number of them."""
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text"))
    key = F.xxhash64("text")
    several = (rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high"))
               .where("low <> high").select(F.col("doc_id").alias("s_id")))
    several = written(several, "several")
    each = rows.join(several, F.col("doc_id") == F.col("s_id"), "left_semi").select("doc_id", key.alias("t_key")).distinct()
    ranks = group_ranks(each, "doc_id", [F.col("t_key")], ["doc_id", "t_key"])
    twins = written(ranks.select(F.col("doc_id").alias("t_id"), "t_key", F.col("_rank").cast("int").alias("rank")), "twins")
    return (rows.join(twins, (F.col("doc_id") == F.col("t_id")) & (key == F.col("t_key")), "left")
            .select("doc_id", F.coalesce("rank", F.lit(0)).alias("twin"), "text"))


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[list[tuple[int | None, int, bytes]]]:
    """Rows ``(doc_id, twin, text bytes)`` in lists of about ``limit`` bytes."""
    out: list[tuple[int | None, int, bytes]] = []
    size = 0
    for batch in batches:
        for i, twin, text in zip(*(batch.column(c) for c in ("doc_id", "twin", "text"))):
            data = text_bytes(text.as_py())
            out.append((i.as_py(), twin.as_py(), data))
            size += len(data)
            if size >= limit:
                yield out
                out, size = [], 0
    if out:
        yield out


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def split(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions in order) for each bucket that occurs."""
    order = np.argsort(bucket.astype(np.uint16 if n <= 65536 else np.int64), kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cut)):
        yield int(b), order[cut[b]:cut[b + 1]]


def doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    return (mix64(doc.view(np.uint64) + np.uint64(1)) % np.uint64(n)).astype(np.int64)


def to_docs(kind: int, n: int, doc: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Records for documents, packed by document bucket, in order of id."""
    if not len(doc):
        return []
    out = []
    order = np.lexsort((columns[1], doc))
    doc, columns = doc[order], [c[order] for c in columns]
    for b, at in split(doc_bucket(doc, n), n):
        out.append((b, kind, pack(gaps(doc[at]), *(c[at] for c in columns))))
    return out


def with_texts(rows: DataFrame, records: DataFrame, n: int) -> DataFrame:
    """Rows of texts (kind -1, data: the compressed text) and records for them,
    brought together by document bucket: the records of a bucket come before
    its texts.  ``rows(doc_id, twin, text)``, ``records(bucket, kind, data)``."""
    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = part.column("doc_id").to_pylist()
                texts = part.column("text").to_pylist()
                known = doc_bucket(np.array([i or 0 for i in ids], np.int64), n)
                # rows without an id have no records; any bucket does
                bucket = [int(b) if i is not None else zlib.crc32(text_bytes(t)) % n for i, b, t in zip(ids, known, texts)]
                data = [None if t is None else press.compress(text_bytes(t)) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket, pa.int32()), pa.array([-1] * len(ids), pa.int32()), part.column("doc_id"),
                     part.column("twin"), pa.array(data, pa.binary())], names=["bucket", "kind", "doc_id", "twin", "data"])
    texts = rows.mapInArrow(shrink, "bucket int, kind int, doc_id long, twin int, data binary")
    both = texts.unionByName(records.select("bucket", "kind", F.lit(None).cast("long").alias("doc_id"),
                                            F.lit(None).cast("int").alias("twin"), "data"))
    return both.repartition("bucket").sortWithinPartitions("bucket", F.col("kind").desc())


class Records:
    """The records of one document bucket, looked up by (doc_id, twin)."""

    def __init__(self, blobs: list[list[np.ndarray]]) -> None:
        self.found = bool(blobs)
        if blobs:
            columns = [np.concatenate(c) for c in zip(*blobs)]
            order = np.lexsort((columns[1], columns[0]))
            self.doc, self.twin, *self.columns = [c[order] for c in columns]

    def of(self, doc: int | None, twin: int) -> list[np.ndarray] | None:
        if not self.found or doc is None:
            return None
        a, b = np.searchsorted(self.doc, doc, "left"), np.searchsorted(self.doc, doc, "right")
        if a == b:
            return None
        c = a + np.searchsorted(self.twin[a:b], twin, "left")
        d = a + np.searchsorted(self.twin[a:b], twin, "right")
        return [x[c:d] for x in self.columns] if c < d else None


def texts_with_records(batches: Iterator[pa.RecordBatch], kinds: set[int]):
    """What :func:`with_texts` brings together, one text at a time:
    ``(doc_id, twin, text bytes or None, records by kind)``."""
    expand = zstandard.ZstdDecompressor()
    at, blobs, ready = None, {k: [] for k in kinds}, None
    for batch in batches:
        for bucket, kind, doc, twin, data in zip(*(batch.column(c) for c in ("bucket", "kind", "doc_id", "twin", "data"))):
            b = bucket.as_py()
            if b != at:
                at, blobs, ready = b, {k: [] for k in kinds}, None
            k = kind.as_py()
            if k >= 0:
                if k in kinds:
                    first, *rest = unpack(data.as_py())
                    blobs[k].append([np.cumsum(first), *rest])
                continue
            if ready is None:
                ready = {x: Records(v) for x, v in blobs.items()}
                blobs = {x: [] for x in kinds}
            raw = data.as_py()
            i, t = doc.as_py(), twin.as_py()
            yield i, t, None if raw is None else expand.decompress(raw), {x: r.of(i, t) for x, r in ready.items()}


_POWER = np.uint64(0xD6E8FEB86659FD93)           # odd, so it has an inverse
_SECOND = np.uint64(0xA0761D6478BD642F)


class Rolling:
    """Polynomial hashes modulo 2 ** 64 of all windows of a sequence."""

    def __init__(self, base: np.uint64 = _POWER) -> None:
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(0, np.uint64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        if len(self.up) < n + 1:
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, self.base)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, self.inverse)], dtype=np.uint64)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((sums[end] - sums[start]) * self.down[start])

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        return mix64((sums[width:] - sums[:-width]) * self.down[:len(sums) - width])


def second_rolling() -> Rolling:
    return Rolling(_SECOND)
