"""Filter interaction audit by truth-table survival words.

A document fails some of five filters.  Of the 32 subsets of the filters it
survives those that hold none that it fails: its *survival word* has a bit for
each subset.  Counting every bit over all words of a part gives the survivors
of every subset, and these 32 numbers answer any question about orders of the
filters: what a filter removes at a step, what it would have removed but for
the steps before, what only it fails, its Shapley value.

Bits are counted by carry-save adders: three words become a sum and a carry
word with two logical steps for all 32 positions at once, until a few words of
every weight are left.  Tasks send one row for each part and subset, whatever
the number of documents; nothing else is shuffled but small rows (ids, digests
and flags) for two joins by document id, so that no group of copies meets in
one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import written

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Bounds of the rules (fixed values).
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 100, 80, 10
MARKS = b"#$%&*|"
#: Classes of documents that are counted apart.
ALL, GOOD, TOXIC = 0, 1, 2
#: Words that a task holds before it adds them up.
_CHUNK = 1 << 16


def failures(data: bytes) -> int:
    """Which of A to D a text fails, a bit for each.

    A: under 100 words; B: under 80 % of the words distinct; C: over 10 % of
    the characters are capitals A-Z; D: a mark of ``#$%&*|``."""
    words = data.split()
    flat = np.frombuffer(data, np.uint8)
    capitals = int(np.count_nonzero((flat - np.uint8(65)) < 26))
    points = len(data) - int(np.count_nonzero((flat & 0xC0) == 0x80))
    fails = (len(words) < MIN_WORDS,
             100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
             100 * capitals > MAX_CAPITAL_PERCENT * points,
             any(m in data for m in MARKS))
    return sum(1 << i for i, f in enumerate(fails) if f)


def survival_words() -> np.ndarray:
    """For each set of failed filters the word of the subsets survived."""
    sets = np.arange(SUBSETS)
    survives = (sets[:, None] & sets[None, :]) == 0
    return (survives.astype(np.uint64) << sets.astype(np.uint64)).sum(1).astype(np.uint32)


class PositionalCount:
    """Counts of every bit position over many words, with multiplicities."""

    def __init__(self) -> None:
        self.held: dict[int, list[np.ndarray]] = {}      # words of weight 2 ** level
        self.size = 0
        self.counts = np.zeros(32, np.int64)

    def add(self, words: np.ndarray, times: np.ndarray) -> None:
        """A word that stands for ``times`` documents goes to the level of
        each bit of that number."""
        level = 0
        while len(times) and times.any():
            some = words[(times & 1).astype(bool)]
            if len(some):
                self.held.setdefault(level, []).append(some)
                self.size += len(some)
            times, level = times >> 1, level + 1
        if self.size >= _CHUNK:
            self.reduce()

    def reduce(self) -> None:
        """Carry-save: a, b and c of one weight become their sum bits (that
        weight) and their carry bits (the next)."""
        held = {k: np.concatenate(v) for k, v in self.held.items()}
        level = 0
        while held:
            x = held.pop(level, None)
            while x is not None and len(x) > 2:
                n = len(x) // 3
                a, b, c = x[:n], x[n:2 * n], x[2 * n:3 * n]
                half = a ^ b
                carry = (a & b) | (half & c)
                up = held.get(level + 1)
                held[level + 1] = carry if up is None else np.concatenate([up, carry])
                x = np.concatenate([half ^ c, x[3 * n:]])
            if x is not None:
                self.counts += ((x[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)).sum(0).astype(np.int64) << level
            level += 1
        self.held, self.size = {}, 0

    def total(self) -> np.ndarray:
        self.reduce()
        return self.counts


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column("data").to_pylist()]
        digest = [xxhash.xxh3_128_digest(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array(map(failures, texts), pa.int32()), pa.array(digest, pa.binary())],
            names=["doc_id", "part", "failed", "digest"])


def flags(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``(part, failed, good, toxic, n)``: documents with the set of filters
    that they fail and their labels; ``n`` rows are alike.

    A null text is empty, a null part the empty string.  Repeated labels of an
    id count if one says so; labels of other ids, null ids and null labels say
    nothing.  Filter E fails for a text that a smaller id has; a null id is
    neither smaller nor larger than any, and rows of one id are no copies of
    each other.  Rows that repeat are counted as often as they occur.
    """
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), F.coalesce(docs[f"`{part}`"].cast("string"), F.lit("")).alias("part"),
                       docs[f"`{text}`"].cast("binary").alias("data"))
    judged = rows.mapInArrow(_judge, "doc_id long, part string, failed int, digest binary")
    judged = written(judged.groupBy("doc_id", "part", "failed", "digest").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    named = judged.where("doc_id is not null")
    first = (named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
             .select("doc_id", "digest", F.lit(True).alias("first")))
    marked = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    late = F.when(F.col("first").isNull(), SUBSETS >> 1).otherwise(0)
    known = (named.join(first, ["doc_id", "digest"], "left").join(marked, "doc_id", "left")
             .select("part", (F.col("failed") + late).alias("failed"), F.coalesce("good", F.lit(0)).alias("good"),
                     F.coalesce("toxic", F.lit(0)).alias("toxic"), "n"))
    nameless = judged.where("doc_id is null").select("part", "failed", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n")
    return known.unionByName(nameless)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word = survival_words()
    by: dict[tuple[str, int], PositionalCount] = {}
    for batch in batches:
        part = batch.column("part").dictionary_encode()
        code = part.indices.to_numpy(zero_copy_only=False)
        failed, good, toxic, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("failed", "good", "toxic", "n"))
        words = word[failed]
        for i, name in enumerate(part.dictionary.to_pylist()):
            for kind, of in ((ALL, code == i), (GOOD, (code == i) & (good == 1)), (TOXIC, (code == i) & (toxic == 1))):
                if of.any():
                    by.setdefault((name, kind), PositionalCount()).add(words[of], n[of])
    for (name, kind), count in by.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * SUBSETS), pa.array([kind] * SUBSETS, pa.int32()), pa.array(range(SUBSETS), pa.int32()),
             pa.array(count.total())], names=["part", "kind", "subset", "n"])


def survivors(flagged: DataFrame) -> DataFrame:
    """``(part, subset, documents, good, toxic)``: how many documents of a part
    survive each subset of the filters (bit i: filter i is in it)."""
    counted = flagged.mapInArrow(_count, "part string, kind int, subset int, n long")
    of = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(name)
          for k, name in ((ALL, "documents"), (GOOD, "good"), (TOXIC, "toxic"))]
    return counted.groupBy("part", "subset").agg(*of)


REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def orders_of(left: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple]:
    """The report rows of one part from its survivors of every subset."""
    n, full = len(FILTERS), SUBSETS - 1
    shapley = [sum(factorial(bin(s).count("1")) * factorial(n - 1 - bin(s).count("1")) * int(left[s] - left[s | 1 << f])
                   for s in range(SUBSETS) if not s >> f & 1) for f in range(n)]
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed = int(left[before] - left[after])
            yield ("".join(FILTERS[i] for i in order), step, int(left[after]), removed, int(left[0] - left[1 << f]) - removed,
                   int(left[full & ~(1 << f)] - left[full]), int(good[before] - good[after]), int(toxic[before] - toxic[after]), shapley[f])
            before = after


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
    names = [c.split()[0] for c in REPORT.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            arrays = [np.zeros(SUBSETS, np.int64) for _ in range(3)]
            for s in row["by_subset"]:
                for a, c in zip(arrays, ("documents", "good", "toxic")):
                    a[s["subset"]] = s[c]
            cols = zip(*((row["part"], *x) for x in orders_of(*arrays)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def report(counts: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from :func:`survivors`:
    documents ``kept`` after the step, ``removed`` in it, ``redundant`` (they
    fail its filter but are gone), ``unique_fails`` (they fail it only),
    ``good_lost`` and ``toxic_lost`` of those removed, and ``shapley`` (what
    the filter removes, summed over all orders).  One row of 32 subsets per
    part is all that meets; an empty table has no parts and no rows."""
    each = counts.groupBy("part").agg(F.collect_list(F.struct("subset", "documents", "good", "toxic")).alias("by_subset"))
    return each.mapInArrow(_report, REPORT)


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The whole report; see :func:`flags` for nulls and repeated rows."""
    return report(survivors(flags(docs, labels, doc_id, text, part)))
