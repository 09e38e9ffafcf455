"""Line dedup by two Bloom filters.

A line's key is the line without white space at its ends and with A-Z in lower
case.  Keys of at least ``MIN_CHARS`` characters that ``MIN_DOCUMENTS``
documents hold lose all their lines except those of one document.

1. All keys' hashes go into two filters: seen once, and seen twice.  Tasks
   send a few bits per distinct key; the finished twice-seen filter goes to all
   workers and has a bound (see ``bloom``).
2. The second pass probes that filter.  Only suspected repeats are shuffled:
   (key digest, document), made distinct, counted exactly, the largest document
   of each key chosen.  A key that only looked repeated is dropped here.
3. The digests of lost lines meet their document's text by document bucket.

A key that very many documents hold is counted by partial aggregates; the join
of its documents with its one row is split where it is too large for a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm import bloom
from placeweave.llm.common import bucket_count, written
from placeweave.llm.packed import SCHEMA, batch_of, texts_with_records, to_docs, with_texts

MIN_CHARS, MIN_DOCUMENTS = 20, 3
#: What is stripped from both ends of a line.
WHITE = b" \t\n\x0b\x0c\r"
#: Texts of one document bucket (bytes, about); lost lines sent together.
TEXT_PER_BUCKET, _FLUSH = 32 << 20, 500_000
DROPPED = 5
_LATER = bytes(range(0x80, 0xC0))             # bytes that begin no character


def key_of(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    key = line.strip(WHITE)
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and not key.isascii():
        if len(key.translate(None, _LATER)) < min_chars:
            return None
    return key.lower()                        # of bytes: A-Z only


def digests(text: bytes, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the line, high and low half of its key's digest) of every
    line that counts."""
    at, raw = [], []
    for i, line in enumerate(text.split(b"\n")):
        key = key_of(line, min_chars)
        if key is not None:
            at.append(i)
            raw.append(xxhash.xxh3_128_digest(key))
    both = np.frombuffer(b"".join(raw), ">u8").astype(np.uint64).reshape(-1, 2)
    return np.array(at, np.int64), both[:, 0].copy(), both[:, 1].copy()


def _see(n_blocks: int, min_chars: int):
    """Documents → the bits of their keys, packed by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            h, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return bloom.seen_batch(h, h[times > 1], n_blocks)

        for batch in batches:
            for data in batch.column("data").to_pylist():
                held.append(np.unique(digests(data, min_chars)[1]))      # once per document
                size += len(held[-1])
                if size >= bloom.HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()
    return run


def _suspect(sent, n_blocks: int, min_chars: int):
    """Documents → their keys that the twice-seen filter knows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bloom.Filter(sent.value, n_blocks)
        for batch in batches:
            found = [digests(d, min_chars)[1:] for d in batch.column("data").to_pylist()]
            n = [len(h) for h, _ in found]
            ids = np.repeat(batch.column("doc_id").to_numpy(), n)
            high, low = (np.concatenate([f[k] for f in found] or [np.empty(0, np.uint64)]) for k in (0, 1))
            keep = seen.has(high)
            yield pa.RecordBatch.from_arrays([pa.array(high[keep].view(np.int64)), pa.array(low[keep].view(np.int64)), pa.array(ids[keep])],
                                             names=["high", "low", "doc_id"])
    return run


def _records(n_docs: int):
    """(document, digest) of lost lines → records by document bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            doc, high, low = (np.concatenate(c) for c in zip(*held))
            held.clear()
            return batch_of(to_docs(DROPPED, n_docs, doc, np.zeros(len(doc), np.int32), high, low))

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("doc_id", "high", "low")))
            if sum(len(x[0]) for x in held) >= _FLUSH:
                yield flush()
        if held:
            yield flush()
    return run


def _drop(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def batch():
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                              names=["doc_id", "n_lines", "n_dropped", "kept"])

        for doc, _, data, found in texts_with_records(batches, {DROPPED}):
            text, gone = data or b"", 0
            n = text.count(b"\n") + 1
            if found[DROPPED] is not None:
                lost = set(zip(*(x.tolist() for x in found[DROPPED])))
                at, high, low = digests(text, min_chars)
                drop = {i for i, h in zip(at.tolist(), zip(high.view(np.int64).tolist(), low.view(np.int64).tolist())) if h in lost}
                text = b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in drop)
                gone = len(drop)
            out.append((doc, n, gone, text.decode("utf-8", "surrogatepass")))
            size += len(text) + 64
            if size > 8 << 20:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()
    return run


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS,
               doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept)`` for every row of ``docs``:
    ``kept`` is the lines that stay, joined by a line feed.

    The largest id that holds a key keeps all its lines of that key.  A null
    or empty text is one empty line.  Rows of one id are one document: they
    count once for a key and lose the same keys.  Rows without an id neither
    count nor lose lines.  An empty table gives no rows; other columns are not
    read.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text"))
    feeds = F.length("text") - F.length(F.translate("text", "\n", ""))
    lines, size = rows.agg(F.sum(feeds + 1), F.sum(F.octet_length("text"))).first()
    n_blocks = bloom.blocks_for(int(lines or 0))
    known = rows.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("binary").alias("data"))
    twice = bloom.collected(known.select("data").mapInArrow(_see(n_blocks, min_chars), bloom.SEEN), twice=True)
    sent = spark.sparkContext.broadcast(twice)
    suspects = written(known.mapInArrow(_suspect(sent, n_blocks, min_chars), "high long, low long, doc_id long").distinct(), "line-suspects")
    # written, so that the join below stands on plain shuffles, which Spark can split
    repeats = written(suspects.groupBy(F.col("high").alias("r_high"), F.col("low").alias("r_low"))
                      .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_documents), "line-repeats")
    lost = (suspects.join(repeats, (F.col("high") == F.col("r_high")) & (F.col("low") == F.col("r_low")))
            .where("doc_id <> keeper").select("doc_id", "high", "low"))
    n_docs = bucket_count(spark, int(size or 0), TEXT_PER_BUCKET)
    records = written(lost.mapInArrow(_records(n_docs), SCHEMA), "line-drops")
    return with_texts(rows.withColumn("twin", F.lit(0)), records, n_docs).mapInArrow(
        _drop(min_chars), "doc_id long, n_lines long, n_dropped long, kept string")
