"""End-to-end job: requests + captured pages → business rows, error rows,
run statistics (the reference's E-1, E-2 and E-3 flows as one plan).

Captured pages: ``page_id, kind ('listing'|'detail'|'website'), request_id,
region_pos, place_id, url, captured_at, html``.  A listing page answers one
(request, region) search; a detail page belongs to a place id; a website
page is keyed by its URL.

Plan shape (one shuffle per relational step, none in extraction):

1. X1 + L1–L12 per listing page (narrow), per-page slice to ``max_results``.
2. Join to the expanded requests on ``(request_id, region_pos)`` — the
   request side is small per request and AQE broadcasts it when it measures
   it small; otherwise a sort-merge join.
3. W2 first-wins across regions, W3 cut per request (map-side group limits).
4. Enrich after dedupe (same answer as the reference, less work): details by
   place id (one row per id, partial aggregate first), then e-mails by
   website URL (small projection of website pages).
5. URL-driven rows (never enriched) are unioned by name; error rows go to
   their own table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.operators import emails as E
from placeweave.operators import relational as R
from placeweave.operators.details import detail_fields
from placeweave.operators.elements import NO_CONTENT, page_elements
from placeweave.operators.listing import listing_arrays, listing_rows
from placeweave.session import checkpoint_dir
from placeweave.sources import requests as RQ
from placeweave.sources import runs, sinks

CAPTURED_PAGE_SCHEMA = ("page_id BIGINT, kind STRING, request_id BIGINT, region_pos INT, place_id STRING, "
                        "url STRING, captured_at TIMESTAMP, html STRING")

# Output order of the business table.
BUSINESS_COLUMNS = ("query", "source_url", "timestamp", "name", "placeId", "latitude", "longitude", "rating",
                    "reviews", "address", "businessType", "phone", "url", "website", "hours", "hoursDetail",
                    "priceLevel", "email", "emails")
BUSINESS_TYPES = {
    "query": "string", "source_url": "string", "timestamp": "timestamp", "name": "string", "placeId": "string",
    "latitude": "double", "longitude": "double", "rating": "double", "reviews": "bigint", "address": "string",
    "businessType": "string", "phone": "string", "url": "string", "website": "string", "hours": "array<string>",
    "hoursDetail": "map<string,string>", "priceLevel": "string", "email": "string", "emails": "array<string>",
}


def row_counts() -> dict[str, Column]:
    """What the rows themselves say about a run; also counted while they are
    written."""
    n_emails = F.size(F.coalesce(F.col("emails"), F.array().cast("array<string>")))
    return {"n": F.count(F.lit(1)), "emails_found": F.coalesce(F.sum(n_emails), F.lit(0)).cast("long")}


#: A2: what became of the detail pages.
DETAIL_OUTCOMES = ("details_success", "details_failed", "details_missing", "details_orphan")


@dataclass
class RunResult:
    businesses: DataFrame
    errors: DataFrame
    searches: DataFrame
    failed: DataFrame
    extracted: DataFrame
    outcomes: DataFrame

    @property
    def stats(self) -> DataFrame:
        return self.stats_of(self.businesses)

    def stats_of(self, businesses: DataFrame) -> DataFrame:
        """A1 and A2 of the run from its business rows — the lazy ones, or the
        rows as they were written, so that nothing is extracted again."""
        return run_stats(self, businesses.agg(*[c.alias(k) for k, c in row_counts().items()]))

    def write(self, path: str, fmt: str = "parquet", mode: str = "append", run: str | None = None) -> DataFrame:
        """Write the business rows; the statistics, with what was counted in
        the same pass.  With a ``run`` the rows are appended under that name
        (parquet, ``sources.runs``): writing the run again replaces them."""
        if run is not None:
            seen = runs.append_run(self.businesses, path, run, row_counts())
        else:
            seen = sinks.write_businesses(self.businesses, path, fmt=fmt, mode=mode, metrics=row_counts())
        spark = self.businesses.sparkSession
        return run_stats(self, spark.range(1).select(*[F.lit(seen[k]).cast("long").alias(k) for k in row_counts()]))


def _conform(df: DataFrame) -> DataFrame:
    cols = []
    for c in BUSINESS_COLUMNS:
        col = F.col(c) if c in df.columns else F.lit(None)
        cols.append(col.cast(BUSINESS_TYPES[c]).alias(c))
    return df.select(*cols)


def _requests(requests: DataFrame) -> DataFrame:
    req = RQ.normalise_requests(requests)
    for flag in ("scrape_details", "scrape_emails"):
        req = req.withColumn(flag, F.coalesce(F.col(flag), F.lit(True)) if flag in req.columns else F.lit(True))
    return req


def detail_outcomes(kept: DataFrame, details: DataFrame) -> DataFrame:
    """A2: the rows that wanted details (``placeId``, one row each) against
    the captured detail pages (one row per ``placeId``; ``parse_error`` says
    why one could not be read), as one row of counts: rows enriched, rows
    whose page could not be read, rows without a page, and pages that belong
    to no such row.  Both sides are counted per place first, so a place that
    very many searches found is one row of the full outer join."""
    wanted = kept.groupBy("placeId").agg(F.count(F.lit(1)).alias("_rows"))
    pages = details.select(F.col("placeId").alias("_place"), F.col("parse_error").isNull().alias("_ok"))
    both = wanted.join(pages, F.col("placeId") == F.col("_place"), "full_outer")
    return both.agg(
        *[F.coalesce(F.sum(F.when(c, F.col("_rows"))), F.lit(0)).cast("long").alias(name) for name, c in zip(
            DETAIL_OUTCOMES, (F.col("_ok"), ~F.col("_ok"), F.col("_ok").isNull()))],
        F.count_if(F.col("_rows").isNull()).alias(DETAIL_OUTCOMES[3]))


def run(requests: DataFrame, pages: DataFrame, run_ts=None, cut_lineage: bool = False) -> RunResult:
    """Build the whole run as lazy DataFrames (nothing executes here unless
    ``cut_lineage``).

    ``cut_lineage=True`` checkpoints what X1 and the rules found in listing
    and detail pages, and the kept rows (reliable checkpoints in the shared
    ``spark.checkpoint.dir``): businesses, errors and statistics then read
    them, no page is parsed twice, and an executor lost in a later shuffle
    stage never sends Spark back to re-parse HTML."""
    ts = F.current_timestamp() if run_ts is None else F.lit(run_ts).cast("timestamp")
    req = _requests(requests)
    query_req = req.filter(F.col("query").isNotNull() & (F.col("source_url").isNull() | (F.col("source_url") == "")))
    by_url = req.filter(F.col("source_url").isNotNull() & (F.col("source_url") != ""))
    # a failed start URL gives an error row and no business row
    url_req, bad_url = RQ.split_errors(by_url, RQ.url_error_expr("source_url"))
    url_req = RQ.requests_from_urls(url_req, "source_url")

    # One target table: expanded query searches and direct URLs (E-2 rows
    # are never enriched, so their flags are off).
    q_targets = RQ.expand_regions(query_req).select(
        "request_id", "region_pos", F.col("base_query").alias("label"), F.lit(None).cast("string").alias("source_url"),
        "max_results", "scrape_details", "scrape_emails")
    u_targets = url_req.select(
        "request_id", F.lit(0).alias("region_pos"), F.col("query").alias("label"), "source_url", "max_results",
        F.lit(False).alias("scrape_details"), F.lit(False).alias("scrape_emails"))
    targets = q_targets.unionByName(u_targets)

    def cut(df: DataFrame) -> DataFrame:
        return df.checkpoint(eager=True) if cut_lineage else df

    if cut_lineage:
        checkpoint_dir(pages.sparkSession)
    # X1 + L1–L12 run once over all listing pages; what X1 could not read
    # comes out of the same pass.
    listing_pages = pages.filter(F.col("kind") == "listing")
    found = cut(listing_arrays(page_elements(listing_pages, carry=("request_id", "region_pos"))))
    # A search captured several times counts once, by its newest capture that
    # has content (even if that one shows nothing).
    newest = R.one_per_key(
        listing_pages.select(F.struct("request_id", "region_pos").alias("search"), "page_id", "captured_at",
                             F.col("html").isNull().alias("no_content")),
        "search", F.struct(F.col("no_content"), R.newest_first("captured_at", "page_id"))).select(
            F.col("search.request_id").alias("request_id"), F.col("search.region_pos").alias("region_pos"), "page_id")
    rows = (listing_rows(found).join(newest, ["request_id", "region_pos", "page_id"]).join(targets, ["request_id", "region_pos"]))
    cap = RQ.MAX_RESULTS_CAP
    extracted = R.limit_per_query(rows, ["request_id", "region_pos"], ["pos"], limit="max_results", bound=cap)   # per page
    rows = R.dedupe_first(extracted, ["request_id", "placeId"], ["region_pos", "pos"])                       # W2
    rows = cut(R.limit_per_query(rows, "request_id", ["region_pos", "pos"], limit="max_results", bound=cap))  # W3/W4

    # Details by place id, then e-mails by website (left joins, flag-gated).
    detail_pages = pages.filter(F.col("kind") == "detail")
    read = cut(detail_fields(page_elements(detail_pages, carry=("place_id", "captured_at")), with_error=True))
    details = R.one_per_key(read.withColumnRenamed("place_id", "placeId").drop("url", "hours_entries"), "placeId",
                            F.struct(F.col("parse_error").isNotNull(), R.newest_first("captured_at", "page_id"))).drop("page_id", "captured_at")
    outcomes = detail_outcomes(rows.where("scrape_details"), details)
    enriched = R.merge_details(rows, details.where("parse_error is null").drop("parse_error"), enabled=F.col("scrape_details"))
    website_pages = pages.filter(F.col("kind") == "website").select("page_id", "url", "captured_at", "html")
    emailed = E.enrich_emails(enriched, website_pages, shown_only=True)
    gate = F.col("scrape_details") & F.col("scrape_emails")
    emailed = (emailed.withColumn("email", F.when(gate, F.col("email")))
               .withColumn("emails", F.when(gate, F.col("emails"))))

    businesses = _conform(emailed.withColumn("query", F.col("label")).withColumn("timestamp", ts))

    # Failed start URLs, requests without any captured listing page, and
    # pages that could not be read.
    none = F.lit(None).cast("string").alias("query")
    captured = listing_pages.select("request_id").distinct()
    missing = (req.join(captured, "request_id", "left_anti").join(bad_url.select("request_id"), "request_id", "left_anti")
               .select("request_id", "source_url", "query", F.lit("No captured page for this search").alias("error")))
    refused = found.filter(F.col("parse_error").isNotNull())
    no_request = F.lit(None).cast("long").alias("request_id")
    unread = (refused.select("request_id", F.col("url").alias("source_url"), none, F.col("parse_error").alias("error"))
              .unionByName(read.filter(F.col("parse_error").isNotNull())
                           .select(no_request, F.col("url").alias("source_url"), none, F.col("parse_error").alias("error")))
              .unionByName(website_pages.filter(F.col("html").isNull())
                           .select(no_request, F.col("url").alias("source_url"), none, F.lit(NO_CONTENT).alias("error"))))
    errors = (missing.unionByName(bad_url.select("request_id", "source_url", none, "error"))
              .unionByName(unread).withColumn("timestamp", ts))

    # a search failed if it was refused, or if none of its captures could be read
    readable = (newest.join(refused.select("page_id"), "page_id", "left_anti").select("request_id").distinct())
    unseen = (req.join(bad_url.select("request_id"), "request_id", "left_anti").select("request_id")
              .join(readable, "request_id", "left_anti"))
    failed = unseen.unionByName(bad_url.select("request_id"))
    return RunResult(businesses, errors, req.select("request_id"), failed, extracted, outcomes)


def run_stats(run_of: RunResult, counted: DataFrame) -> DataFrame:
    """A1 and A2 for one run as one row: global aggregates over searches,
    failures, extracted rows and detail pages beside what was ``counted`` of
    the business rows, folded by a union and one more aggregate."""
    parts = (run_of.searches.agg(F.count(F.lit(1)).alias("total_searches"))
             .unionByName(counted.select(F.col("n").alias("total_results"), "emails_found"), allowMissingColumns=True)
             .unionByName(run_of.failed.agg(F.count_distinct("request_id").alias("failed_searches")), allowMissingColumns=True)
             .unionByName(run_of.extracted.agg(F.count(F.lit(1)).alias("extracted")), allowMissingColumns=True)
             .unionByName(run_of.outcomes, allowMissingColumns=True))
    one = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    ok = F.col("total_searches") - F.col("failed_searches")
    return one.select(
        "total_searches", "total_results", "failed_searches",
        F.when(F.col("total_searches") > 0, F.floor(F.col("total_results") / F.col("total_searches") + 0.5))
        .otherwise(0).cast("long").alias("avg_results_per_search"),
        F.when(F.col("total_searches") > 0,
               F.concat(F.floor(ok / F.col("total_searches") * 100 + 0.5).cast("long").cast("string"), F.lit("%")))
        .otherwise(F.lit("0%")).alias("success_rate"),
        "extracted", "emails_found", *DETAIL_OUTCOMES, F.col("total_results").alias("final_count"))
