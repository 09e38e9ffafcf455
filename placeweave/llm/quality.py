"""Quality rules and n-gram perplexity bands.

Base figures count words, symbols, repeated lines and repeated 3-word windows.
Perplexity comes from the modified Kneser-Ney model of word n-grams that Spark
counts over all documents and keeps in sorted hash arrays by bucket (see
``ngrams``).  Each language has its own band of log perplexity, around its
median and as wide as its spread (wider for short texts); a document outside
its language's band is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from placeweave.llm.common import mix64, row_key, written
from placeweave.llm.ngrams import PARTS, costs

#: Base rules (fixed values): fewer words, or a larger share of words in
#: repeated 3-word windows, fail.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Fixed value: the characters that count as symbols.
SYMBOL_BYTES = b"#*$%&|<>"
#: A band reaches so many standard deviations below and above the median; the
#: deviation is the language's robust one (in nats per word, not below the
#: floor), raised for short texts: that of a mean of n terms falls with their root.
BAND_BELOW, BAND_ABOVE, DEVIATION_FLOOR, LENGTH_SCALE = 10.0, 2.2, 0.2, 200
#: Width of the bins that log perplexities are counted in.
BIN = 0.001


def base_figures(data: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = data.split()
    n = len(words)
    flat = np.frombuffer(data, np.uint8)
    white = (flat == 32) | ((flat >= 9) & (flat <= 13))
    chars = int((((flat & 0xC0) != 0x80) & ~white).sum())      # code points, not bytes
    marks = int(sum(data.count(SYMBOL_BYTES[i:i + 1]) for i in range(len(SYMBOL_BYTES))))
    lines = [x for x in data.split(b"\n") if x.split()] if b"\n" in data else []
    repeats = 0
    if n >= 3:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        w = mix64(mix64(h[:-2]) * np.uint64(3) + mix64(h[1:-1] + np.uint64(7)) * np.uint64(5) + h[2:])
        order = np.argsort(w, kind="stable")
        same = w[order[1:]] == w[order[:-1]]
        if same.any():
            start = np.zeros(n - 2, bool)
            start[order[1:][same]] = True
            start[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            covered[:-2] |= start
            covered[1:-1] |= start
            covered[2:] |= start
            repeats = int(covered.sum())
    return n, chars, marks, len(lines) - len(set(lines)), repeats


FIGURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}


def figures(rows: DataFrame) -> DataFrame:
    """``rows(…, data)`` without the text, with the base figures."""
    at = rows.columns.index("data")
    schema = StructType([f for f in rows.schema.fields if f.name != "data"])
    for name, kind in FIGURES.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*(base_figures(t.as_py() or b"") for t in batch.column(at)))) or [()] * len(FIGURES)
            other = [batch.column(i) for i in range(batch.num_columns) if i != at]
            names = [x for i, x in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*other, *(pa.array(c, pa.int64()) for c in cols)], names=[*names, *FIGURES])

    return rows.mapInArrow(run, schema)


def bands(scored: DataFrame, by: str = "lang") -> DataFrame:
    """``(band_of, middle, deviation)`` for every language (null is one of its own).

    Log perplexities are counted in bins, so medians are exact to ``BIN`` and
    no language's rows meet: a window holds one language's bins."""
    bins = (scored.where("log_perplexity is not null")
            .groupBy(F.col(by).alias("band_of"), F.floor(F.col("log_perplexity") / BIN).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))

    def median(counts: DataFrame, value: str, name: str) -> DataFrame:
        w = Window.partitionBy("band_of").orderBy(value)
        run = counts.withColumn("upto", F.sum("n").over(w)).withColumn("all_n", F.sum("n").over(Window.partitionBy("band_of")))
        return run.where(F.col("upto") * 2 >= F.col("all_n")).groupBy("band_of").agg(F.min(value).alias(name))

    mid = median(bins, "bin", "mid").withColumnRenamed("band_of", "m_of")
    away = (bins.join(mid, F.col("band_of").eqNullSafe(F.col("m_of")))
            .groupBy("band_of", "mid", F.abs(F.col("bin") - F.col("mid")).alias("off")).agg(F.sum("n").alias("n")))
    spread = median(away, "off", "mad").withColumnRenamed("band_of", "s_of")
    deviation = F.greatest(F.col("mad") * BIN * 1.4826, F.lit(DEVIATION_FLOOR))
    return (mid.join(spread, F.col("m_of").eqNullSafe(F.col("s_of")))
            .select(F.col("m_of").alias("band_of"), ((F.col("mid") + 0.5) * BIN).alias("middle"), deviation.alias("deviation")))


def rate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``row_key``, ``lang``, the base figures,
    ``log_perplexity``, its band ``low`` and ``high``, ``base_failed`` and
    ``kept``.

    A null text counts as empty: it fails the base rules and has no
    perplexity.  Null languages share a band.  Repeated rows all appear; an
    empty table gives no rows; other columns are not read.
    """
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{lang}`"].alias("lang"),
                       docs[f"`{text}`"].alias("text"))
    rows = rows.select("doc_id", "lang", row_key().alias("row_key"), F.col("text").cast("binary").alias("data"))
    cost = (costs(rows.select("row_key", "data")).groupBy(F.col("row_key").alias("c_key"))
            .agg(F.max("words").alias("words"), F.max("cost").alias("cost")))
    joined = figures(rows).join(cost, F.col("row_key") == F.col("c_key"), "left")
    mean = F.when(F.col("words") > 0, F.col("cost") / (F.lit(float(PARTS)) * F.col("words")))
    scored = written(joined.withColumn("log_perplexity", mean).drop("c_key", "words", "cost"), "quality-scores")
    joined = scored.join(bands(scored), F.col("lang").eqNullSafe(F.col("band_of")), "left").drop("band_of")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    wide = F.col("deviation") * F.sqrt(F.lit(1.0) + F.lit(LENGTH_SCALE) / F.greatest(F.col("n_words"), F.lit(1)))
    joined = (joined.withColumn("low", F.when(F.col("n_words") > 0, F.col("middle") - wide * BAND_BELOW))
              .withColumn("high", F.when(F.col("n_words") > 0, F.col("middle") + wide * BAND_ABOVE)).drop("middle", "deviation"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & inside)
