"""One registered query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from placeweave.llm import (decontam, divergence, filteraudit, langid, linededup, mixing, quality, sharding, simhash, substring,
                            suffixdedup, toxicity, urlfilter)
from placeweave.llm.common import documents, held_out, md5_long, table
from placeweave.llm.queries_sql import (DIVERGENCE_SQL, FILTER_AUDIT_SQL, LINE_SQL, SHARDING_SQL, SUBSTRING_SQL, SUFFIX_SQL,
                                        URL_FILTER_SQL)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


# -- Language ----------------------------------------------------------------

@register("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    samples = langid.fit(docs.where(~held_out(4, 2)))
    out = langid.predict(docs.select("doc_id", "text"), samples)
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


# -- Benchmark leaks ---------------------------------------------------------

@register("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "distance", "end")


# -- Toxicity ----------------------------------------------------------------

@register("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(3, 1))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score",
                      (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


# -- URL filters -------------------------------------------------------------

#: Captures are spread by a hash of their id over the days of the list.
FIRST_DAY, DAYS = "2024-01-01", 31


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit(FIRST_DAY).cast("date"),
                     F.pmod(md5_long(F.col("page_id").cast("string")), F.lit(DAYS)).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_on"))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dated list: an event on a page (its ``user_id`` read as a page id)
    lists that page's host — every tenth event the host's parent domain — as
    blocked after an error and allowed after anything else."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    hosts = table(spark, sf_dir, "pages").select("page_id", urlfilter.host_of(F.col("url")).alias("host"))
    domains = urlfilter.domains_of(F.col("host"))
    up = (F.col("event_id") % 10 == 0) & (F.size(domains) > 1)
    return events.join(hosts, events["user_id"] == hosts["page_id"]).select(
        F.when(up, F.get(domains, F.lit(1))).otherwise(F.col("host")).alias("domain"),
        F.col("ts").cast("date").alias("day"),
        F.when(F.col("event_type") == "error", "block").otherwise("allow").alias("action"),
        F.col("event_id").alias("entry_id"))


@register("op4_url_filters", URL_FILTER_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urlfilter.evaluate(captures(spark, sf_dir), list_entries(spark, sf_dir))
    return out.select("page_id", "url", "host", "fetched_on", "matched_domain", "listed_on", "blocked")


# -- Sharding ----------------------------------------------------------------

@register("op6_sharding", SHARDING_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir).select("doc_id")).select("doc_id", "slot", "shard", "shard_name")


# -- Mixing ------------------------------------------------------------------

@register("op7_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


# -- Near duplicates ---------------------------------------------------------

@register("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- Repeated passages, by words ---------------------------------------------

@register("op9_substring", SUBSTRING_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


# -- Quality -----------------------------------------------------------------

@register("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


# -- Repeated passages, by bytes ---------------------------------------------

@register("op5_suffix_array", SUFFIX_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixdedup.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


# -- Audits and lines --------------------------------------------------------

@register("op11_filter_audit", FILTER_AUDIT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@register("op12_line_dedup", LINE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@register("op13_source_divergence", DIVERGENCE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


# -- The pipeline ------------------------------------------------------------

register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
