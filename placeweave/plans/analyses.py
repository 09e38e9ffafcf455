"""Market analyses promised by the reference's README.

All are grouped aggregates, anti joins or bounded per-key windows:
* R1 uses ``cube`` (one shuffle, partial aggregation per grouping set);
* R2 ranks every row by range partitions and prefix sums of their counts;
  with a ``top_k`` the window gets a map-side ``WindowGroupLimit``;
* R6 keeps the two newest rows per key the same way, then folds them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.operators.relational import explode_rows, spread_join
from placeweave.session import scratch_path


def density(df: DataFrame, dims: Sequence[str], lat: str | None = None, lng: str | None = None,
            cell_deg: float = 0.01) -> DataFrame:
    """Business counts for every combination of ``dims`` (a cube; ``ALL``
    marks a rolled-up dimension).  With ``lat``/``lng`` a grid cell of
    ``cell_deg`` degrees is added as a dimension."""
    base = df
    dims = list(dims)
    if lat and lng:
        base = base.withColumn("cell", F.concat_ws(
            ":", F.floor(F.col(lat) / cell_deg).cast("string"), F.floor(F.col(lng) / cell_deg).cast("string")))
        dims.append("cell")
    agg = base.cube(*dims).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    return agg.select(*[F.when(F.col(f"_g_{d}") == 1, F.lit("ALL")).otherwise(F.col(d).cast("string")).alias(d)
                        for d in dims], "n")


#: Finest level of R1's cells: 2 ** 16 columns and rows of the whole globe.
MAX_LEVEL = 16


def _spread_bits(c: Column) -> Column:
    """The low 16 bits of a number, one place apart (bits of a Morton code)."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def _gather_bits(c: Column) -> Column:
    c = c.bitwiseAND(F.lit(0x55555555).cast("long"))
    for shift, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
        c = c.bitwiseOR(F.shiftright(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def morton_cell(lat: Column, lng: Column, level: int = MAX_LEVEL) -> Column:
    """The Morton code of a coordinate's cell; null where there is none.  A
    code without its last two bits is the cell around it."""
    n = 1 << level
    x = F.greatest(F.least(F.floor((lng + 180.0) / 360.0 * n), F.lit(n - 1)), F.lit(0)).cast("long")
    y = F.greatest(F.least(F.floor((lat + 90.0) / 180.0 * n), F.lit(n - 1)), F.lit(0)).cast("long")
    return F.shiftleft(_spread_bits(y), 1).bitwiseOR(_spread_bits(x))


def area_density(df: DataFrame, lat: str, lng: str, most: int, levels: int = MAX_LEVEL) -> DataFrame:
    """R1 by area: cells sized by what is in them.  The globe is one cell of
    level 0; a cell with more than ``most`` rows is cut in four, down to the
    finest level, and empty quarters are left out.  ``(level, cell_x, cell_y,
    n)``: each row with coordinates is in one cell, cells do not overlap.

    Rows become counts of finest cells by a partial aggregate; those are rolled
    up to every level in one shuffle (a Morton code loses two bits per level).
    Whether a cell's parent was cut is read off its siblings: a window of four
    rows.  A city that holds a third of all rows is a few counts."""
    finest = (df.where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).groupBy(morton_cell(F.col(lat), F.col(lng), levels).alias("_code"))
              .agg(F.count(F.lit(1)).alias("_n")))
    every = finest.select("_code", "_n", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    cells = (every.groupBy("level", F.expr(f"shiftright(_code, ({levels} - level) * 2)").alias("_cell")).agg(F.sum("_n").alias("n")))
    around = F.sum("n").over(Window.partitionBy("level", F.shiftright("_cell", 2)))
    leaf = ((F.col("n") <= most) | (F.col("level") == levels)) & ((F.col("level") == 0) | (F.col("_around") > most))
    return (cells.withColumn("_around", around).where(leaf)
            .select("level", _gather_bits(F.col("_cell")).alias("cell_x"), _gather_bits(F.shiftright("_cell", 1)).alias("cell_y"), "n"))


def group_ranks(df: DataFrame, group: str, order: list, keys: list[str]) -> DataFrame:
    """``(keys…, _rank)``: the rank of every distinct key row in its group.

    Key rows are counted, dealt out by range in the groups' order and written
    with the number of their part.  A row's rank is one more than the rows of
    its group in earlier parts and those before it in its own, so a group may
    be larger than any task: windows hold one part's rows of a group, or one
    number per part."""
    spark = df.sparkSession
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    parts = counted.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id())
    path = scratch_path(spark, "ranks")
    parts.write.parquet(path)
    parts = spark.read.schema(parts.schema).parquet(path)
    sizes = parts.groupBy(F.col(group).alias("_s_group"), F.col("_part").alias("_s_part")).agg(F.sum("_n").alias("_size"))
    earlier = Window.partitionBy("_s_group").orderBy("_s_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_earlier", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    before = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    of = F.col(group).eqNullSafe(F.col("_s_group")) & (F.col("_part") == F.col("_s_part"))
    return inside.join(sizes, of).select(*keys, (F.col("_earlier") + F.col("_before") + 1).alias("_rank"))


def rating_rank(df: DataFrame, group: str, score: str, top_k: int | None = None, tiebreak: str | None = None,
                approx_quantiles: bool = False) -> DataFrame:
    """R2: every row's rank by ``score`` in its ``group`` (with ``top_k`` only
    the best ranks), and the group's count, mean (to the cent), min and max.
    ``approx_quantiles`` adds the group's approximate quartiles
    (``percentile_approx``: mergeable sketches, partial aggregation).  Rows
    without a group are ranked among themselves, those without a score last;
    equal rows share a rank."""
    order = [F.col(score).desc()] + ([F.col(tiebreak).asc()] if tiebreak else [])
    if top_k is not None:                # a map-side group limit: few rows of a group move
        w = Window.partitionBy(group).orderBy(*order)
        top = df.withColumn("rank", F.rank().over(w).cast("long")).filter(F.col("rank") <= top_k)
    else:
        keys = [group, score, *([tiebreak] if tiebreak else [])]
        ranks = group_ranks(df, group, order, keys).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        top = df.join(ranks, same).drop(*[f"_k{i}" for i in range(len(keys))]).withColumnRenamed("_rank", "rank")
    cents = F.sum(F.round(F.col(score) * 100)) * 1.0 / F.count(F.lit(1))      # whole cents: exact in any order
    aggs = [F.count(F.lit(1)).alias("group_n"), (F.floor(cents + 0.5) / 100).alias("group_avg"),
            F.min(score).alias("group_min"), F.max(score).alias("group_max")]
    if approx_quantiles:
        aggs.append(F.percentile_approx(score, [0.25, 0.5, 0.75], 10000).alias("group_quartiles"))
    stats = df.groupBy(F.col(group).alias("_of")).agg(*aggs)
    return spread_join(top, stats, [group], ["_of"]).drop("_of")


def rating_distribution(df: DataFrame, group: str, score: str, step: float = 1.0) -> DataFrame:
    """R2: how many rows of each group fall into each score band (``band`` is
    its lower end, null for rows without a score), their share of the group
    and the share of the group that scores no higher than the band.  Bands are
    counted by partial aggregates; a window holds one group's bands."""
    bands = df.groupBy(group, (F.floor(F.col(score) / step) * step).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(group)
    upto = whole.orderBy(F.col("band").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (bands.withColumn("share", F.col("n") / F.sum("n").over(whole))
            .withColumn("share_upto", F.sum("n").over(upto) / F.sum("n").over(whole)))


def no_website(business: DataFrame, captured: DataFrame | None = None, key: str = "website") -> DataFrame:
    """Businesses without a website; with ``captured`` (a table of site
    URLs), also those whose site was never captured (left anti join)."""
    missing = business.filter(F.col(key).isNull() | (F.col(key) == ""))
    if captured is None:
        return missing
    has = business.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    # distinct first: a site captured many times ships one row per map task
    sites = captured.select(F.col(captured.columns[0]).alias(key)).distinct()
    return missing.unionByName(has.join(sites, key, "left_anti"))


def contacts(df: DataFrame, location: str, emails: str = "emails") -> DataFrame:
    """One row per (location, e-mail) with the number of businesses."""
    return (explode_rows(df, [location], F.col(emails), "email")
            .groupBy(location, "email").agg(F.count(F.lit(1)).alias("n_businesses")))


def hours_patterns(df: DataFrame, hours_map: str = "hoursDetail") -> DataFrame:
    """Explode day→hours maps and count each (day, hours) pattern."""
    return (explode_rows(df, [], F.col(hours_map), ("day", "hours"))
            .groupBy("day", "hours").agg(F.count(F.lit(1)).alias("n")))


def latest_snapshot(df: DataFrame, key: str, ts: str, tiebreak: str, value: str) -> DataFrame:
    """Newest row per key and the change since the capture before it.

    ``row_number() <= 2`` (literal) keeps the window's map-side group limit;
    the two rows are folded by a small aggregate."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tiebreak).desc())
    two = df.select(key, ts, tiebreak, value).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2)
    folded = two.groupBy(key).agg(
        F.max(F.when(F.col("_rn") == 1, F.col(tiebreak))).alias(f"latest_{tiebreak}"),
        F.max(F.when(F.col("_rn") == 1, F.col(ts))).alias(f"latest_{ts}"),
        F.max(F.when(F.col("_rn") == 1, F.col(value))).alias(f"latest_{value}"),
        F.max(F.when(F.col("_rn") == 2, F.col(value))).alias(f"previous_{value}"),
        F.count(F.lit(1)).alias("_n"))
    return folded.withColumn(
        "changed", F.when(F.col("_n") < 2, F.lit(None).cast("boolean"))
        .otherwise(~F.col(f"latest_{value}").eqNullSafe(F.col(f"previous_{value}")))).drop("_n")
