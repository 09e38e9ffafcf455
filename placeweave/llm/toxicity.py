"""Toxicity by FTRL-proximal logistic regression over hashed n-grams.

Features of a text: its words (whole, and their first ``STEM`` bytes), pairs of
neighbouring words and pairs that skip one word, each present or not, hashed
into ``DIM`` coordinates.  FTRL-proximal
keeps two numbers per coordinate; its rates fall per coordinate and its L1
term leaves most weights at exactly zero, so what is broadcast for scoring is
a short list of (coordinate, weight), at most ``DIM`` long.

The model is fitted on a sample of at most ``MAX_TRAINING_ROWS`` labelled rows
(the smallest hashes of the id, then of the row) with at most
``MAX_TRAINING_FEATURES`` coordinates in all; every row is scored, over its
whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import map_rows, mix64, text_bytes

DIM_BITS = 20
DIM = 1 << DIM_BITS
#: Bound of the labelled sample that the model is fitted on.
MAX_TRAINING_ROWS = 12_000
#: Bound of the sample's coordinates (4 bytes each): what the fitting task holds.
MAX_TRAINING_FEATURES = 64_000_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
STEM = 4
#: Documents with at least this score count as toxic.
THRESHOLD = 0.7
# ASCII punctuation separates words here: "fool," and "fool" are one feature.
_LETTERS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_NEXT, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct coordinates of a text (none for a null or empty one)."""
    words = text_bytes(text).lower().translate(_LETTERS).split()
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    stems = np.fromiter((digest(w[:STEM]) for w in words), np.uint64, len(words))
    every = np.concatenate([h, mix64(stems + _NEXT), mix64(h[:-1] * _NEXT + h[1:]), mix64(h[:-2] * _SKIP + h[2:])])
    return np.unique((every >> np.uint64(64 - DIM_BITS)).astype(np.int32))


class Ftrl:
    """Per-coordinate FTRL-proximal on binary features plus a bias."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(DIM + 1), np.zeros(DIM + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == DIM, 0.0, L1)        # the bias is not thinned out
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, DIM)
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = [features(t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("label"), pa.array(blobs, pa.binary())],
                                         names=["order", "label", "at"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for b in batches:
        for x, y in zip(b.column("at").to_pylist(), b.column("label").to_pylist()):
            held += len(x) // 4
            if held <= MAX_TRAINING_FEATURES:
                rows.append((np.frombuffer(x, np.int32), y))
    model = Ftrl()
    for _ in range(EPOCHS):
        for at, label in rows:
            model.learn(at, label)
    w = model.weights(np.arange(DIM + 1))
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], names=["at", "weight"])


def fit(docs: DataFrame, labels: DataFrame, learnable=None, max_rows: int = MAX_TRAINING_ROWS,
        doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The non-zero weights ``(at, weight)``; the bias is at ``DIM``.

    ``labels(doc_id, toxic)``; ``learnable`` (a Column of ``doc_id``) says
    which ids may be learned from.  Repeated labels of an id count as toxic if
    one is; null ids and labels teach nothing.  The sampled ids are broadcast to
    the documents, whose texts are not shuffled; of the rows that they find
    (more than ids, where documents repeat an id) the ``max_rows`` with the
    smallest hashes meet in one task, in a fixed order.
    """
    known = labels.where("doc_id is not null and toxic is not null")
    if learnable is not None:
        known = known.where(learnable)
    sample = (known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
              .withColumnRenamed("doc_id", "l_id"))
    rows = (docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"))
            .join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"))
            .select("text", "label", F.xxhash64("doc_id", "text").alias("order")))
    model = (rows.mapInArrow(_extract, "order long, label int, at binary")
             .orderBy("order", "label").limit(max_rows)
             .repartition(1).sortWithinPartitions("order", "label")
             .mapInArrow(_train, "at int, weight double").toPandas())
    return model["at"].to_numpy(np.int64), model["weight"].to_numpy(np.float64)


def probabilities(batch: pa.RecordBatch, at: int, dense: np.ndarray) -> np.ndarray:
    sums = np.array([dense[features(t)].sum() + dense[DIM] for t in batch.column(at).to_pylist()])
    return 1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35)))


def dense_weights(model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    dense = np.zeros(DIM + 1)
    dense[model[0]] = model[1]
    return dense


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` plus ``score`` from 0 to 1 (a column of that
    name in the input is replaced).  A null or empty text has the score of
    the bias.  No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop(*[c for c in docs.columns if c.lower() == score_col.lower()])
    at = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = dense_weights(sent.value)
        for batch in batches:
            p = probabilities(batch, at, dense)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "n0"])

    return map_rows(base, run, **{score_col: "double"})


def clean(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = dense_weights(sent.value)
        for batch in batches:
            yield batch.filter(pa.array(probabilities(batch, at, dense) < threshold, pa.bool_()))

    return map_rows(docs, run)
