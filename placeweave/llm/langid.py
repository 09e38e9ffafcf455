"""Language identification by compression.

Each language has a raw-content dictionary of sample texts.  A text is encoded
with zstandard against every dictionary; the language whose encoding is the
smallest wins, and a win by a narrow margin is marked as rejected.  Texts and
samples are lower-cased and reduced to their letters first.  Long texts are
encoded in pieces of ``PIECE`` bytes, so every part of a text meets the
dictionary and memory stays bounded; all pieces count.

Only the samples reach the driver: at most ``SAMPLE_ROWS`` rows of
``SAMPLE_CHARS`` characters per language (the smallest hashes of the row).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeweave.llm.common import map_rows, text_bytes

#: Bounds of the labelled sample per language.
SAMPLE_ROWS, SAMPLE_CHARS = 64, 400
PIECE = 1 << 16
#: A win by a smaller share of the second-best size is rejected.
MIN_MARGIN = 0.01
UNKNOWN = "und"
# Bytes of a sequence beyond ASCII stay; of ASCII, only letters do.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def letters(text: str | None) -> bytes:
    return b" ".join(text_bytes(text and text.lower()).translate(_LETTERS).split())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def encoders(samples: dict[str, list[str]]) -> dict[str, zstandard.ZstdCompressor]:
    """A compressor per language; the search depth is a fixed value."""
    out = {}
    for lang in sorted(samples):
        p = zstandard.ZstdCompressionParameters(
            window_log=18, chain_log=16, hash_log=16, search_log=3, min_match=4, target_length=16,
            strategy=zstandard.STRATEGY_BTLAZY2, write_checksum=False, write_content_size=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(b" ".join(map(letters, samples[lang])) or b" " * 8,
                                          dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        out[lang] = zstandard.ZstdCompressor(compression_params=p, dict_data=d)
    return out


def classify(text: str | None, by: dict[str, zstandard.ZstdCompressor]) -> tuple[str, float, bool]:
    """(language, score, rejected).  A text that is null or has no letter is
    ``und`` with score 0; equal sizes go to the first language in order.  The
    score is the winner's share when each byte saved counts e ** (1 / 4)."""
    if not by or not has_letter(text):
        return UNKNOWN, 0.0, True
    data = letters(text)
    pieces = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
    sizes = [(sum(len(c.compress(p)) for p in pieces), lang) for lang, c in by.items()]
    best, lang = min(sizes)
    others = sorted(s for s, x in sizes if x != lang)
    score = 1.0 / sum(np.exp(-min(s - best, 400) / 4.0) for s, _ in sizes)
    margin = (others[0] - best) / others[0] if others else 1.0
    return lang, float(score), margin < MIN_MARGIN


def fit(rows: DataFrame, lang: str = "lang", text: str = "text", order=None) -> dict[str, list[str]]:
    """Samples per language from rows with a language and a letter; null
    languages and texts teach nothing, copies of a sample teach it once.
    ``order`` draws the sample; a row's piece starts at a hashed place of its
    whole text.  Ranked in two steps, so no task holds a language's rows."""
    t = F.col(f"`{text}`")
    known = rows.select(F.col(f"`{lang}`").alias("lang"), t.alias("t"), (F.xxhash64(t) if order is None else order).alias("order"))
    start = F.pmod(F.xxhash64("t", F.lit(1)), F.greatest(F.length("t") - SAMPLE_CHARS + 1, F.lit(1)).cast("long"))
    known = known.select("lang", F.substring(F.col("t"), start.cast("int") + 1, F.lit(SAMPLE_CHARS)).alias("piece"), "order")
    known = known.where(F.col("lang").isNotNull() & F.col("piece").rlike("\\p{L}"))
    known = known.groupBy("lang", "piece").agg(F.min("order").alias("order"))
    part = F.row_number().over(Window.partitionBy("lang", F.pmod("order", F.lit(64))).orderBy("order", "piece"))
    known = known.withColumn("n", part).where(F.col("n") <= SAMPLE_ROWS)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "piece"))
    samples: dict[str, list[str]] = {}
    for row in known.withColumn("n", rank).where(F.col("n") <= SAMPLE_ROWS).orderBy("lang", "n").toLocalIterator():
        samples.setdefault(row["lang"], []).append(row["piece"])
    return samples


def predict(docs: DataFrame, samples: dict[str, list[str]], text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred``, ``score`` and ``rejected``
    (columns of these names in the input are replaced); every row stays, and
    no other column is looked at.  No shuffle."""
    own = {"lang_pred": "string", "score": "double", "rejected": "boolean"}
    base = docs.drop(*[c for c in docs.columns if c.lower() in own])
    at = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoders(samples)
        for batch in batches:
            found = [classify(t, by) for t in batch.column(at).to_pylist()]
            cols = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "n0", "n1", "n2"])

    return map_rows(base, run, **own)
