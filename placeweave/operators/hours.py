"""Opening hours: day→hours entries, the ordered hours list (D4) and the map
(``hoursDetail``).

Weekly hours are kept as an ordered ``ARRAY<STRUCT<day, hours>>`` because
Spark maps have no defined order and D4's fallback uses source order.  A
repeated day keeps its first position and its last value (JavaScript object
assignment), and is de-duplicated before ``map_from_entries`` (which would
throw on a repeated key).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave.functions.text import first_only_replace, js_trim, let, literal_first_replace

# Day names in output order.
DAYS_EN = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
DAYS_ZH = ("星期一", "星期二", "星期三", "星期四", "星期五", "星期六", "星期日")
MAY_DIFFER = "營業時間可能不同"
TWO_RANGES = r"([0-9]{1,2}:[0-9]{2}[–-][0-9]{1,2}:[0-9]{2})([0-9]{1,2}:[0-9]{2}[–-][0-9]{1,2}:[0-9]{2})"
TWO_TIMES = r"([0-9]{2}:[0-9]{2})([0-9]{2}:[0-9]{2})"
ENTRY_TYPE = "array<struct<day:string,hours:string>>"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def split_glued(col) -> Column:
    """Separate two glued ranges (``12:00–15:0017:30–22:00``) by a space."""
    return F.regexp_replace(F.regexp_replace(_c(col), TWO_RANGES, "$1 $2"), TWO_TIMES, "$1 $2")


def dedupe_entries(entries) -> Column:
    """First position, last value per day."""
    def body(e: Column) -> Column:
        # a NULL day cannot be a map key; such entries carry no day to show
        days = F.filter(F.array_distinct(F.transform(e, lambda x: x["day"])), lambda d: d.isNotNull())
        return F.transform(days, lambda d: F.struct(
            d.alias("day"),
            F.try_element_at(F.filter(e, lambda x: x["day"] == d), F.lit(-1))["hours"].alias("hours")))
    return let(_c(entries), body)


def hours_map(entries) -> Column:
    """``hoursDetail``: day → hours (NULL when there are no entries)."""
    return let(dedupe_entries(entries), lambda e: F.when(F.size(e) > 0, F.map_from_entries(e)))


def _ordered(e: Column, days) -> Column:
    """``Day: hours`` for the listed days present with non-empty hours."""
    wanted = F.array(*[F.lit(d) for d in days])
    found = F.transform(wanted, lambda d: F.struct(
        d.alias("day"), F.try_element_at(F.filter(e, lambda x: x["day"] == d), F.lit(1))["hours"].alias("hours")))
    return F.transform(F.filter(found, lambda x: F.coalesce(x["hours"], F.lit("")) != ""),
                       lambda x: F.concat(x["day"], F.lit(": "), split_glued(x["hours"])))


def hours_list(entries) -> Column:
    """``"Day: hours"`` strings — Monday..Sunday if any English day is
    present, else 星期一..星期日, else source order without "hours may differ"
    days, bracketed notes cut from the day and empty hours dropped."""
    return let(dedupe_entries(entries), _hours_list)


def _hours_list(e: Column) -> Column:
    en = _ordered(e, DAYS_EN)
    zh = _ordered(e, DAYS_ZH)
    fallback = F.filter(
        F.transform(F.filter(e, lambda x: ~x["day"].contains(MAY_DIFFER)), lambda x: F.struct(
            js_trim(first_only_replace(x["day"], r"\([^)]+\)", "")).alias("d"),
            js_trim(literal_first_replace(split_glued(x["hours"]), F.lit(MAY_DIFFER), "")).alias("h"))),
        lambda x: x["h"] != "")
    fb = F.transform(fallback, lambda x: F.concat(x["d"], F.lit(": "), x["h"]))
    return let(en, lambda a: F.when(F.size(a) > 0, a).otherwise(
        let(zh, lambda b: F.when(F.size(b) > 0, b).otherwise(fb))))
