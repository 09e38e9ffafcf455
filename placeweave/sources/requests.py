"""Request tables: O1 (normalise), O2 (direct URLs), O3 (search URL), J1
(region expansion), O4 (error split).

A request table has one row per search: ``(request_id, query, source_url,
language, max_results, use_multi, regions)``.  Everything here is a narrow
projection or an ``explode`` of a bounded list — no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions.text import js_trim

# Fixed values taken from the reference behaviour.
MAX_RESULTS_CAP = 200
DEFAULT_MAX_RESULTS = 100
DEFAULT_LANGUAGE = "en"
MULTI_SEARCH_MIN_RESULTS = 50          # multi-region only when max_results > 50
DEFAULT_REGIONS = ("", "North", "South", "East", "West", "Downtown", "Near me")
SEARCH_BASE = "https://www.google.com/maps/search/"
DIRECT_URL_LABEL = "Direct URL"

REQUEST_SCHEMA = ("request_id BIGINT, query STRING, source_url STRING, language STRING, "
                  "max_results INT, use_multi BOOLEAN, regions ARRAY<STRING>")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalise_requests(df: DataFrame) -> DataFrame:
    """O1: trim queries and drop blank ones, cap ``max_results`` at 200, fill
    defaults (100 results, ``en``).  Rows that carry a ``source_url`` are kept
    even without a query.  Raising on an empty request set is the caller's
    job (:func:`require_requests`)."""
    q = js_trim(F.col("query"))
    has_query = F.col("query").isNotNull() & (q != "")
    has_url = F.col("source_url").isNotNull() & (F.col("source_url") != "")
    return (df.filter(has_query | has_url)
            .withColumn("query", F.when(has_query, q))
            .withColumn("language", F.coalesce(F.nullif("language", F.lit("")), F.lit(DEFAULT_LANGUAGE)))
            # `maxResults || 100`: a missing or zero limit means 100
            .withColumn("max_results", F.least(F.coalesce(F.nullif("max_results", F.lit(0)),
                                                          F.lit(DEFAULT_MAX_RESULTS)),
                                               F.lit(MAX_RESULTS_CAP)).cast("int"))
            .withColumn("use_multi", F.coalesce("use_multi", F.lit(False))))


def require_requests(df: DataFrame) -> DataFrame:
    """Fail like the reference when there is nothing to search."""
    if df.isEmpty():
        raise ValueError("Please provide either searchQueries or startUrls")
    return df


def uri_component(c: Column) -> Column:
    """``encodeURIComponent`` from ``url_encode`` (form encoding)."""
    e = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for enc, ch in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        e = F.replace(e, F.lit(enc), F.lit(ch))
    return e


def with_search_url(df: DataFrame, query: str = "query", language: str = "language") -> DataFrame:
    """O3: ``search_url`` = base + percent-encoded query + ``?hl=`` language;
    ``non_ascii`` flags queries with any non-ASCII character."""
    return (df.withColumn("search_url", F.concat(F.lit(SEARCH_BASE), uri_component(_c(query)),
                                                 F.lit("?hl="), _c(language)))
            .withColumn("non_ascii", _c(query).rlike(r"[^\x00-\x7F]")))


def url_label_expr(url) -> Column:
    """O2: text after ``/search/`` in the URL path up to the next ``/``,
    percent-decoded (``+`` kept); ``Direct URL`` when the path has no
    ``/search/``; NULL when the escape sequence is malformed (→ O4)."""
    path = F.regexp_extract(_c(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    has = F.instr(path, "/search/") > 0
    # JavaScript split('/search/')[1]: the piece between the first and the
    # second occurrence; then its text up to the first '/'.
    piece = F.substring_index(F.split(path, "/search/", 2).getItem(1), "/search/", 1)
    raw = F.substring_index(piece, "/", 1)
    decoded = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.when(has & (piece != ""), decoded).otherwise(F.lit(DIRECT_URL_LABEL))


# Why a start URL fails before anything is searched.
INVALID_URL, MALFORMED_ESCAPE = "Invalid URL", "URI malformed"


def url_error_expr(url) -> Column:
    """Why a start URL fails, or NULL: it is no absolute URL, or its label
    holds a malformed escape."""
    return (F.when(~F.coalesce(_c(url).rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#\s]+([/?#]|\z)"), F.lit(False)), F.lit(INVALID_URL))
            .when(url_label_expr(url).isNull(), F.lit(MALFORMED_ESCAPE)))


def requests_from_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """O2: one request per start URL with its query label (NULL where the URL
    fails)."""
    return (df.withColumn("query", F.when(url_error_expr(url).isNull(), url_label_expr(url)))
            .withColumn("source_url", F.col(url)))


def split_errors(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)``: rows where ``error`` is NULL, and the others with
    it as their ``error``."""
    marked = df.withColumn("error", error)
    return marked.filter(F.col("error").isNull()).drop("error"), marked.filter(F.col("error").isNotNull())


def expand_regions(df: DataFrame) -> DataFrame:
    """Base query × regions (the request's own list, else the 7 defaults,
    the first of which is the bare query), only for multi-search requests
    with ``max_results > 50``; others get one row with ``region_pos = 0``.

    Adds ``base_query``, ``region_pos`` and ``region``; ``query`` becomes the
    searched text."""
    defaults = F.array(*[F.lit(r) for r in DEFAULT_REGIONS])
    regions = F.when(F.coalesce(F.size("regions"), F.lit(0)) <= 0, defaults).otherwise(F.col("regions")) \
        if "regions" in df.columns else defaults
    multi = F.col("use_multi") & (F.col("max_results") > MULTI_SEARCH_MIN_RESULTS)
    chosen = F.when(multi, regions).otherwise(F.array(F.lit("")))
    out = df.withColumn("base_query", F.col("query")).select(
        "*", F.posexplode(chosen).alias("region_pos", "region"))
    searched = F.when(F.col("region") != "", F.concat_ws(" ", "base_query", "region")).otherwise(F.col("base_query"))
    return out.withColumn("query", searched)


__all__ = ["normalise_requests", "require_requests", "with_search_url", "url_label_expr",
           "requests_from_urls", "split_errors", "url_error_expr", "expand_regions"]
