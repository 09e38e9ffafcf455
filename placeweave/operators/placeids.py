"""Place id and coordinates of a place link (L1–L4).

Input columns: ``href`` (the resolved link URL), optional ``data_pid``,
``data_place_id``, ``data_value`` (attributes of the link), ``parent_pid``,
``parent_place_id`` (attributes of its parent), ``first_div`` (text of the
link's first ``div``), ``page_id`` and ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions.text import float_prefix, js_trim, let

# The id patterns, in priority order.
PLACE_PATH = r"/place/[^/]+/([^/?]+)"
DATA_CHI = r"[!&]1s(ChI[^!&?]+)"
PID_19S = r"!19s(ChI[^!&?]+)"
HEX_ID = r"[!&]1s(0x[0-9a-f]+:0x[0-9a-f]+)"
COORDS = r"!3d([^!]+)!4d([^!]+)"

TWO_32 = 4294967296
TWO_31 = 2147483648


def _opt(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _nz(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def js_string_hash(s) -> Column:
    """``h = ((h << 5) - h) + charCodeAt(i); h |= 0`` over UTF-16 code units,
    as a signed 32-bit value (kept in LONG arithmetic modulo 2^32)."""
    c = F.col(s) if isinstance(s, str) else s
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("([0-9A-F]{4})"), 1)
    unsigned = F.aggregate(units, F.lit(0).cast("long"),
                           lambda acc, u: F.pmod(acc * 31 + F.conv(u, 16, 10).cast("long"), F.lit(TWO_32)))
    return F.when(unsigned >= TWO_31, unsigned - TWO_32).otherwise(unsigned)


def generated_id(name, lat_text, lng_text) -> Column:
    """L2: ``generated_`` + base-36 of |hash(name_lat_lng)|."""
    key = F.concat_ws("_", name, lat_text, lng_text)
    return F.concat(F.lit("generated_"), F.lower(F.conv(F.abs(js_string_hash(key)).cast("string"), 10, 36)))


def place_id_expr(df: DataFrame) -> Column:
    """L1–L3: first non-null of the id rules; everything after ``?`` cut.
    ``href`` is bound once, so a filter pushed below the projection that
    computes it does not multiply its code."""
    return let(F.col("href"), lambda href: place_id_of(
        href, _opt(df, "data_pid"), _opt(df, "data_place_id"), _opt(df, "data_value"),
        _opt(df, "parent_pid"), _opt(df, "parent_place_id"), _opt(df, "first_div"),
        F.col("page_id"), F.col("pos")))


def place_id_of(href: Column, data_pid: Column, data_place_id: Column, data_value: Column,
                parent_pid: Column, parent_place_id: Column, first_div: Column,
                page_id: Column, pos: Column) -> Column:
    """L1–L3 over explicit columns (usable inside HOF lambdas)."""
    path_id = F.regexp_extract(href, PLACE_PATH, 1)
    attr = F.coalesce(_nz(data_pid), _nz(data_place_id), _nz(data_value))
    parent = F.coalesce(_nz(parent_pid), _nz(parent_place_id))
    hex_id = F.regexp_extract(href, HEX_ID, 1)
    name = F.coalesce(js_trim(first_div), F.lit(""))
    lat_t, lng_t = F.regexp_extract(href, COORDS, 1), F.regexp_extract(href, COORDS, 2)
    has_coords = href.rlike(COORDS)
    pid = F.coalesce(
        F.when(path_id.startswith("ChI"), path_id),
        _nz(F.regexp_extract(href, DATA_CHI, 1)),
        _nz(F.regexp_extract(href, PID_19S, 1)),
        F.when(attr.startswith("ChI"), attr),
        F.when(parent.startswith("ChI"), parent),
        F.when(hex_id != "", F.concat(F.lit("hex_"), hex_id)),
        F.when((name != "") & has_coords, generated_id(name, lat_t, lng_t)),
        # L3, deterministic: the reference appends the wall clock here.
        F.concat(F.lit("fallback_"), page_id.cast("string"), F.lit("_"), pos.cast("string")),
    )
    return F.substring_index(pid, "?", 1)


def with_place_id(links: DataFrame) -> DataFrame:
    """L1–L3 as a column ``placeId``."""
    return links.withColumn("placeId", place_id_expr(links))


def coordinate_of(href: Column, i: int) -> Column:
    """L4 for one coordinate (1 = latitude, 2 = longitude)."""
    return F.when(href.rlike(COORDS), float_prefix(F.regexp_extract(href, COORDS, i)))


def with_coordinates(links: DataFrame) -> DataFrame:
    """L4: ``latitude``/``longitude`` from ``!3d…!4d…`` (prefix number parse)."""
    return (links.withColumn("latitude", coordinate_of(F.col("href"), 1))
            .withColumn("longitude", coordinate_of(F.col("href"), 2)))


def tag_attr_expr(tag, name: str) -> Column:
    """Value of attribute ``name`` in a start tag's text (double, single or
    unquoted), NULL when absent."""
    t = F.col(tag) if isinstance(tag, str) else tag
    ws = r"[ \t\n\f\r]"
    dq = rf"""(?is)[ \t\n\f\r"']{name}{ws}*={ws}*"([^"]*)\""""
    sq = rf"""(?is)[ \t\n\f\r"']{name}{ws}*={ws}*'([^']*)'"""
    bare = rf"""(?is)[ \t\n\f\r"']{name}{ws}*={ws}*([^ \t\n\f\r"'>]+)"""
    return F.coalesce(F.when(t.rlike(dq), F.regexp_extract(t, dq, 1)),
                      F.when(t.rlike(sq), F.regexp_extract(t, sq, 1)),
                      F.when(t.rlike(bare), F.regexp_extract(t, bare, 1)))
