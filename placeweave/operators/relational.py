"""Relational operators: first-wins dedupe (W1, W2), per-query top-N (W3, W4),
unions (U1, U2), left enrich joins (J2, J3 / D13) and substring anti-match (J4).

Scale notes
-----------
* ``row_number() … <= k`` with a literal ``k`` lets Catalyst insert a
  ``WindowGroupLimit`` on the map side, so a hot key ships at most ``k`` rows
  per map task into the shuffle — a key holding a third of the input does
  not land whole in one task.
* Enrich joins first reduce the right side to one row per key with a partial
  aggregate (``min_by``), so the join never multiplies left rows and AQE can
  pick broadcast or sort-merge from runtime sizes; AQE's skew-join split
  handles hot keys on the left.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.functions import text as T


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Keep the first row per ``keys`` by ``order`` (not
    ``dropDuplicates``, which keeps an arbitrary row)."""
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def limit_per_query(df: DataFrame, key: str | Sequence[str], order: Sequence,
                    limit: int | str = "max_results", bound: int | None = None, rank_col: str | None = None) -> DataFrame:
    """The first ``limit`` rows per query in ``order``.

    ``limit`` is an int or a column name.  Where a column's values have a known
    upper bound (O1 caps ``max_results``), the caller names it as ``bound``: a
    literal lets Catalyst put a group limit on the map side."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    rn = rank_col or "_rn"
    out = df.withColumn(rn, F.row_number().over(w))
    literal = limit if isinstance(limit, int) else bound
    if literal is not None:
        out = out.filter(F.col(rn) <= F.lit(literal))
    if not isinstance(limit, int):
        out = out.filter(F.col(rn) <= F.col(limit))
    return out if rank_col else out.drop(rn)


def explode_rows(df: DataFrame, keep, array, alias: str | tuple[str, str], pos: str | None = None) -> DataFrame:
    """One row per element of ``array`` (rows with NULL/empty arrays vanish),
    keeping the columns ``keep``.

    Uses ``posexplode_outer`` and drops the padding row by its NULL position.
    A plain ``explode`` of a column computed in a lower projection makes
    Catalyst infer ``size(col) > 0`` below the generator, which inlines (and
    so re-runs) the whole expression that built the array."""
    names = list(alias) if isinstance(alias, tuple) else [alias]
    p = pos or "_xpos"
    out = (df.select(*keep, F.posexplode_outer(array).alias(p, *names))
           .filter(F.col(p).isNotNull()))
    return out if pos else out.drop(p)


def where_computed(df: DataFrame, keep, computed: dict[str, Column], predicate) -> DataFrame:
    """Rows whose freshly computed values satisfy ``predicate``, with the
    values as columns.

    ``df.select(expr.alias(c)).filter(p(c))`` lets Catalyst push the filter
    below the projection (and below a round-robin spread), which evaluates
    the expensive expression twice and before the spread.  Here the values
    are packed into a one-element array that is filtered inside the
    projection and exploded: a filter cannot cross the generator, so each
    value is computed once, where the rows are already spread."""
    packed = F.struct(*[c.alias(n) for n, c in computed.items()])
    arr = F.filter(F.array(packed), lambda s: predicate(s))
    return explode_rows(df, list(keep), arr, "_w").select(*keep, *[F.col(f"_w.{n}").alias(n) for n in computed])


def union_results(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name; missing columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def newest_first(ts: str, tiebreak: str) -> Column:
    """An ascending order: latest ``ts`` first (null last), then ``tiebreak``."""
    return F.struct(F.coalesce(-F.unix_micros(F.col(ts).cast("timestamp")), F.lit(2 ** 63 - 1)), F.col(tiebreak))


def one_per_key(df: DataFrame, key: str, order: str | Column) -> DataFrame:
    """Reduce ``df`` to one row per ``key`` (smallest ``order`` wins) with a
    partial aggregate; all other columns are kept."""
    others = [c for c in df.columns if c != key]
    packed = F.struct(*[F.col(c) for c in others])
    return (df.groupBy(key).agg(F.min_by(packed, F.col(order) if isinstance(order, str) else order).alias("_r"))
            .select(key, *[F.col(f"_r.{c}").alias(c) for c in others]))


# Rules applied to detail values after the non-empty test.
DETAIL_RULES = {
    "address": T.standard_address,
    "priceLevel": T.standard_price,
    "businessType": T.standard_type,
}


def merge_details(listing: DataFrame, detail: DataFrame, key: str = "placeId",
                  fields: Sequence[str] = ("address", "phone", "website", "hours", "hoursDetail",
                                           "priceLevel", "businessType"),
                  enabled: Column | None = None) -> DataFrame:
    """Left-join details onto listings; a detail value replaces the
    listing value only when non-empty.  ``address``, ``priceLevel`` and
    ``businessType`` pass through C5, C3, C2 after that test and may end up
    ``''``.  ``hours`` replaces when present (an empty list counts, as in the
    reference).  ``detail`` must hold at most one row per key (see
    :func:`one_per_key`).  ``enabled`` (a boolean column of ``listing``) limits
    the merge to rows whose request asked for details."""
    present = [f for f in fields if f in detail.columns]
    dtypes = dict(detail.dtypes)
    listing_cols = set(listing.columns)
    d = detail.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_d_{f}") for f in present])
    joined = listing.join(d, listing[key] == d["_k"], "left")
    merged = {}
    for f in present:
        dv = F.col(f"_d_{f}")
        dtype = dtypes[f]
        if dtype == "string":
            take = dv.isNotNull() & (dv != "")
            value = DETAIL_RULES[f](dv) if f in DETAIL_RULES else dv
        elif dtype.startswith("map"):
            take = dv.isNotNull() & (F.size(dv) > 0)
            value = dv
        else:
            take = dv.isNotNull()
            value = dv
        base = F.col(f) if f in listing_cols else F.lit(None).cast(dtype)
        if enabled is not None:
            take = take & enabled
        merged[f] = F.when(take, value).otherwise(base)
    return joined.withColumns(merged).drop("_k", *[f"_d_{f}" for f in present])


def anti_match(df: DataFrame, column: str, needles: Sequence[str]) -> DataFrame:
    """Rows whose ``column`` contains none of ``needles`` (case-insensitive).

    The needle list is a fixed, short list, so it is inlined as a predicate
    (no join at all) rather than broadcast."""
    low = F.lower(F.col(column))
    hit = F.lit(False)
    for n in needles:
        hit = hit | low.contains(n.lower())
    return df.filter(~hit)


def spread_join(rows: DataFrame, small: DataFrame, keys: list[str], small_keys: list[str], parts: int = 16) -> DataFrame:
    """Inner join (null-safe) of ``rows`` with a table of one row per key, in
    which a key that holds very many rows goes to ``parts`` tasks: its rows are
    dealt out by their own content, its one row is repeated for each."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c, kind in rows.dtypes if not kind.startswith("map")]), F.lit(parts))
    left = rows.withColumn("_salt", salt.cast("int"))
    right = small.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    on = F.col("_salt") == F.col("_copy")
    for a, b in zip(keys, small_keys):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return left.join(right, on).drop("_salt", "_copy")


def grams_of(text: Column, n: int) -> Column:
    """The distinct pieces of ``n`` characters of a text."""
    last = F.length(text) - n
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i + 1, F.lit(n))))) \
        .otherwise(F.array().cast("array<string>"))


def anti_match_table(df: DataFrame, column: str, needles: DataFrame, needle: str, gram: int = 3) -> DataFrame:
    """J4 for a blacklist that is a table: rows whose ``column`` contains none
    of its words (case-insensitive).  Null values stay; null and empty words
    match nothing.

    Instead of testing every word on every row, distinct values meet words by a
    shared piece of ``gram`` characters (a shorter word: the whole word).  A
    word is keyed by that of its pieces which the fewest values have, and not
    at all if some piece is in none, so frequent pieces ("com") key nothing
    that has a rarer one.  Hits are verified on the whole word, then the rows
    go by an anti join on the value."""
    words = (needles.select(F.lower(F.col(needle)).alias("_word")).where("_word is not null and _word <> ''").distinct()
             .withColumn("_n", F.least(F.length("_word"), F.lit(gram))))
    sizes = sorted(r[0] for r in words.select("_n").distinct().collect())          # at most ``gram`` numbers
    values = df.select(F.lower(F.col(column)).alias("_value")).where("_value is not null").distinct()
    if not sizes:
        return df
    pieces = values.select("_value", F.explode(F.flatten(F.array(*[grams_of(F.col("_value"), n) for n in sizes]))).alias("_gram"))
    often = pieces.groupBy(F.col("_gram").alias("_g")).agg(F.count(F.lit(1)).alias("_times"))
    own = reduce(lambda a, b: a.unionByName(b), [words.where(F.col("_n") == n).select("_word", F.explode(grams_of(F.col("_word"), n)).alias("_of"))
                                                 for n in sizes])
    keyed = (own.join(often, F.col("_of") == F.col("_g"), "left").groupBy("_word")
             .agg(F.min_by(F.col("_of"), F.struct(F.coalesce("_times", F.lit(0)), "_of")).alias("_key"), F.min(F.coalesce("_times", F.lit(0))).alias("_least"))
             .where("_least > 0").select("_word", "_key"))
    hits = (pieces.join(keyed, F.col("_gram") == F.col("_key")).where(F.col("_value").contains(F.col("_word")))
            .select(F.col("_value").alias("_hit")).distinct())
    return df.join(hits, F.lower(F.col(column)) == F.col("_hit"), "left_anti")
