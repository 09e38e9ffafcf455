"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target number of words.  Whole repeats of the source fill
what they can; the rest is a budget to be met by a subset of its documents.
Only the number of documents of each exact length matters for that, so Spark
counts documents by (source, length) and each source's plan is made from its
counts: a proportional share of every length, then the largest lengths that
still fit, then a bounded-knapsack dynamic programme over the small remainder.
The plan is a number of documents for each length; which ones is drawn by a
seeded hash, so reruns agree.

Scale: nothing but counts leaves the rows.  A (source, length) that holds very
many documents (a group of copies, say) is ranked in hashed slices, so no
window holds more than about ``SLICE`` rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeweave.llm.common import WORD, fresh, written

SEED = 17
#: No document is taken more often.
MAX_REPEATS = 3
#: Words of remaining budget that the dynamic programme covers.
DP_WORDS = 20_000
#: Documents of one source and length that are ranked together.
SLICE = 20_000


#: What separates words (``WORD`` excludes exactly these).
_WHITE = " \t\n\x0b\f\r"


def size_of(text) -> F.Column:
    """Number of words.  Each word becomes one letter and the letters are
    counted: ``regexp_count`` would make an array of all words first."""
    marks = F.regexp_replace(text, WORD, "x")
    return F.coalesce(F.length(F.translate(marks, _WHITE, "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sources(source, source_size)`` with ``weight`` and ``target``.

    Sources in code-point order, null last, weigh ``weights`` in turn and
    share all words by weight; a target stops at ``max_repeats`` times its
    source, and the excess is shared again until none is above.  That is
    ``min(level * weight, cap)`` for one level, found here by sorting the
    sources by the level at which each is full: below it lie the full ones.
    Works on one row per source, in one task: a source is a row of some 50
    bytes there, so a million sources are 50 MB.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("n") - 1) % len(weights) + 1)
    # UTF-8 byte order, Spark's order of strings, is code-point order.
    ranked = (sources.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
              .withColumn("weight", w.cast("double"))
              .withColumn("cap", F.col("source_size").cast("double") * max_repeats)
              .withColumn("full_at", F.col("cap") / F.col("weight")))
    below = Window.orderBy("full_at", "n").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (ranked
             .withColumn("words", F.sum("source_size").over(everything).cast("double"))
             .withColumn("left_words", F.col("words") - F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
             .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
             .withColumn("level", F.col("left_words") / F.col("left_weight"))
             # the level holds from the first source that it does not fill
             .withColumn("the_level", F.min_by(F.col("level"), F.when(F.col("level") <= F.col("full_at"),
                                                                      F.struct("full_at", "n"))).over(everything)))
    return level.select("source", "source_size", "weight",
                        F.coalesce(F.least(F.col("the_level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come as
    near ``budget`` from below as the counts allow (all of them if it is not
    smaller than their sum)."""
    order = np.argsort(-lengths, kind="stable")
    size, have = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((size * have).sum())
    if budget >= total:
        return counts.astype(np.int64)
    take = np.minimum(have, (have.astype(object) * budget // max(total, 1)).astype(np.int64))
    left = budget - int((size * take).sum())
    for i in np.flatnonzero(size > 0):        # lengths in falling order
        if left <= dp_words:
            break
        more = min(int(have[i] - take[i]), (left - dp_words + int(size[i]) - 1) // int(size[i]), left // int(size[i]))
        take[i] += more
        left -= more * int(size[i])
    # bounded knapsack: for each sum the length that first reached it (a larger
    # remainder than dp_words is left only if no further length fits)
    usable = np.flatnonzero((size > 0) & (size <= left) & (have > take))
    left = left if len(usable) else 0
    by = np.full(left + 1, -1, np.int64)
    by[0] = -2
    for i in usable:
        if by[left] != -1:
            break
        s, spare = int(size[i]), int(have[i] - take[i])
        used = np.zeros(left + 1, np.int64)   # copies of this length below each sum
        for a in range(s, left + 1, s):
            b = min(a + s, left + 1)
            new = (by[a:b] == -1) & (by[a - s:b - s] != -1) & (used[a - s:b - s] < spare)
            if not new.any():
                continue
            by[a:b][new] = i
            used[a:b][new] = used[a - s:b - s][new] + 1
    at = int(np.flatnonzero(by != -1)[-1])
    while at > 0:
        i = int(by[at])
        take[i] += 1
        at -= int(size[i])
    out = np.empty_like(take)
    out[order] = take
    return out


def _plan(frame: pd.DataFrame) -> pd.DataFrame:
    """One source's counts → its plan; a row for each length."""
    target, words = float(frame["target"].iloc[0]), int(frame["source_size"].iloc[0])
    whole = min(MAX_REPEATS, int(target // words)) if words else 0
    budget = max(0, round(target - whole * words)) if whole < MAX_REPEATS else 0
    extra = fit(frame["size"].to_numpy(), frame["docs"].to_numpy(), budget) if words else np.zeros(len(frame), np.int64)
    return pd.DataFrame({"source": frame["source"], "size": frame["size"], "docs": frame["docs"], "whole": whole, "extra": extra})


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = (1, 2, 3),
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_key``, ``size``,
    ``source``, ``source_size``, ``target`` and ``copies`` — how often the mix
    takes the document.

    A null text has size 0; documents without words cost no budget and are
    never taken.  Null sources are one source of their own, last in order.
    Ties of the draw (repeated rows) differ in nothing that the result shows.
    Only the three named columns are read.
    """
    rows = written(docs.select(
        docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{source}`"].alias("source"),
        size_of(docs[f"`{text}`"]).alias("size"), F.xxhash64(docs[f"`{text}`"]).alias("text_key")), "mix-rows")
    counts = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs"))
    goal = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")), weights)
    goal = written(goal, "mix-targets")
    plan = (counts.join(goal.withColumnRenamed("source", "g_source"), F.col("source").eqNullSafe(F.col("g_source")))
            .groupBy("g_source")
            .applyInPandas(_plan, "source string, size long, docs long, whole int, extra long"))
    plan = written(plan, "mix-plan").withColumn(
        "slices", F.ceil(F.col("docs") / SLICE).cast("int")).withColumnsRenamed({"source": "p_source", "size": "p_size"})
    joined = (rows.join(plan, rows["source"].eqNullSafe(plan["p_source"]) & (rows["size"] == plan["p_size"]))
              .withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "text_key"))
              .withColumn("slice", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text_key"), F.col("slices").cast("long")))
              .drop("p_source", "p_size"))
    # only a length that the plan splits needs a ranking, slice by slice
    split = joined.where("extra > 0 and extra < docs")
    kept = joined.where("extra <= 0 or extra >= docs").withColumn("extra_copy", (F.col("extra") > 0).cast("int"))
    sizes = split.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("in_slice"))
    before = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (sizes.withColumn("ahead", F.coalesce(F.sum("in_slice").over(before), F.lit(0)))
             .withColumnsRenamed({"source": "s_source", "size": "s_size", "slice": "s_slice"}))
    rank = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("draw", "doc_id", "text_key"))
    drawn = (split.withColumn("rank", rank)
             .join(sizes, split["source"].eqNullSafe(F.col("s_source")) & (split["size"] == F.col("s_size"))
                   & (split["slice"] == F.col("s_slice")))
             .withColumn("extra_copy", (F.col("ahead") + F.col("rank") <= F.col("extra")).cast("int")))
    cols = ["doc_id", "text_key", "source", "size", "whole", "extra_copy"]
    out = kept.select(*cols).unionByName(drawn.select(*cols))
    goal = goal.withColumnRenamed("source", "g_source")
    return (out.join(goal, out["source"].eqNullSafe(goal["g_source"]))
            .select("doc_id", "text_key", "source", "size", "source_size", "target",
                    F.when(F.col("size") > 0, F.col("whole") + F.col("extra_copy")).otherwise(0).cast("int").alias("copies")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: each row as
    often as the mix takes it (rows that it never takes are gone)."""
    doc_id, text, source = (options.get(k, k) for k in ("doc_id", "text", "source"))
    m = mix(docs, **options)
    # equal rows are told apart by number only: they share out their copies
    take = (m.groupBy("doc_id", "source", "text_key")
            .agg(F.sum("copies").alias("all_copies"), F.count(F.lit(1)).alias("same")))
    i, s, k, n, r, w = fresh(docs, "m_id", "m_source", "m_key", "m_copies", "m_row", "m_whole")
    take = take.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("text_key").alias(k),
                       F.col("all_copies").alias(n), F.col("same").alias(r))
    d_id, d_source = docs[f"`{doc_id}`"], docs[f"`{source}`"]
    joined = docs.join(take, d_id.eqNullSafe(take[i]) & d_source.eqNullSafe(take[s])
                       & (F.xxhash64(docs[f"`{text}`"]) == take[k]))
    # in an order of the whole rows, so a stage that runs again takes the same
    whole = F.xxhash64(*[docs[f"`{c}`"] for c, kind in docs.dtypes if not kind.startswith("map")])
    joined = joined.withColumn(w, whole)
    rank = F.row_number().over(Window.partitionBy(i, s, k).orderBy(w))
    single = joined.where(F.col(r) == 1).withColumn(r, F.lit(0).cast("long"))
    several = joined.where(F.col(r) > 1).withColumn(
        n, F.floor(F.col(n) / F.col(r)) + (rank <= F.col(n) % F.col(r)).cast("long")).withColumn(r, F.lit(0).cast("long"))
    both = single.unionByName(several.withColumn(n, F.col(n).cast("long")))
    return (both.where(F.col(n) > 0).withColumn(r, F.explode(F.array_repeat(F.lit(0), F.col(n).cast("int"))))
            .drop(i, s, k, n, r, w))
