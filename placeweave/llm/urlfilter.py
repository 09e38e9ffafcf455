"""URL filters: captures against dated list entries, as of the fetch time.

A list entry (domain, day, action) holds from its day until the next entry of
the same domain.  ``intervals`` turns entries into such validity intervals;
``evaluate`` looks every capture's host and parent domains up among the
entries that were active on its fetch day.  The most specific domain with an
active entry decides: ``block`` or ``allow``.

Scale: the verdict depends only on (host, day), so captures are first reduced
to their distinct pairs (a host with a third of all captures becomes one row
per day), entries to one per (domain, day).  The as-of join is an equi-join on
(domain, month) with the interval as its condition: an interval is repeated
for each month it touches, so a pair meets at most a month of entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeweave.llm.common import fresh

#: Host of an absolute URL: scheme, optional user part, host, optional port.
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
#: Open intervals end here.
FOREVER = "9999-12-31"


def host_of(url) -> F.Column:
    """Lower-case host without trailing dot; null where there is none."""
    host = F.lower(F.regexp_replace(F.regexp_extract(url, HOST, 1), "\\.$", ""))
    return F.when(host != "", host)


def domains_of(host) -> F.Column:
    """The host and its parent domains down to two labels, longest first."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                       lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """``entries(domain, day, action, entry_id)`` as validity intervals
    ``(domain, action, valid_from, valid_to)``.

    Several entries of a domain on one day: the one with the largest
    ``entry_id`` counts (equal ids: ``block`` before ``allow``).  Rows with a
    null domain, day or action say nothing.  A window holds one domain's days.
    """
    clean = (entries.where("domain is not null and day is not null and action is not null")
             .groupBy("domain", "day")
             .agg(F.max_by("action", F.struct(F.coalesce("entry_id", F.lit(-1)), "action")).alias("action")))
    w = Window.partitionBy("domain").orderBy("day")
    return clean.select("domain", "action", F.col("day").alias("valid_from"),
                        F.coalesce(F.lead("day").over(w), F.lit(FOREVER).cast("date")).alias("valid_to"))


def _month(day) -> F.Column:
    return F.year(day) * 12 + F.month(day)


def verdicts(pairs: DataFrame, valid: DataFrame) -> DataFrame:
    """One row per distinct ``(host, day)`` that an active entry decides:
    ``(host, day, matched_domain, action, listed_on)``."""
    keys = pairs.select("host", "day", F.explode(domains_of(F.col("host"))).alias("domain"),
                        _month(F.col("day")).alias("month"))
    # An open interval is listed up to the last month that any pair asks for.
    last = pairs.agg(F.max(_month(F.col("day"))).alias("last_month"))
    spread = (valid.join(F.broadcast(last))      # one row
              .withColumn("first", _month(F.col("valid_from")))
              .withColumn("until", F.least(_month(F.date_sub("valid_to", 1)), F.col("last_month")))
              .where("until >= first")
              .select("domain", "action", "valid_from", "valid_to",
                      F.explode(F.sequence("first", "until")).alias("month")))
    hit = keys.join(spread, ["domain", "month"]).where("day >= valid_from and day < valid_to")
    best = F.max_by(F.struct("domain", "action", "valid_from"), F.length("domain")).alias("best")
    return (hit.groupBy("host", "day").agg(best)
            .select("host", "day", F.col("best.domain").alias("matched_domain"),
                    F.col("best.action").alias("action"), F.col("best.valid_from").alias("listed_on")))


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """Every capture with ``host``, ``matched_domain``, ``listed_on`` and
    ``blocked`` (columns of these names in the input are replaced).

    A capture without a host or a fetch day, and one that no active entry
    covers, is not blocked (its other columns are null).  Repeated captures
    stay; with no entries or no captures the result has the same columns.
    """
    own = {"host", "matched_domain", "listed_on", "blocked"}
    host, day = fresh(captures, "host", "day")
    base = captures.select("*", host_of(captures[f"`{url}`"]).alias(host),
                           captures[f"`{fetched}`"].cast("date").alias(day))
    base = base.drop(*[c for c in captures.columns if c.lower() in own])
    pairs = (base.where(F.col(host).isNotNull() & F.col(day).isNotNull())
             .select(F.col(host).alias("host"), F.col(day).alias("day")).distinct())
    v = verdicts(pairs, intervals(entries)).withColumnsRenamed({"host": "v_host", "day": "v_day"})
    return (base.join(v, (base[host] == v["v_host"]) & (base[day] == v["v_day"]), "left")
            .withColumn("blocked", F.coalesce(F.col("action") == "block", F.lit(False)))
            .withColumnRenamed(host, "host")
            .drop(day, "v_host", "v_day", "action"))
