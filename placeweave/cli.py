"""Command line: run the business job from a run-input JSON and captured pages.

    python -m placeweave.cli --input input.json --pages /data/pages --out /data/run1 [--format json]

The input JSON has the reference's run-input shape: ``searchQueries``,
``startUrls`` (objects with ``url`` or plain strings), ``maxResults``,
``language``, ``scrapeDetails``, ``scrapeEmails``, ``useMultiSearch``,
``searchRegions``.  Captured pages use ``CAPTURED_PAGE_SCHEMA``; a listing
page's ``request_id`` is the position of its search in the input (queries
first, then start URLs).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from placeweave.plans.business_run import CAPTURED_PAGE_SCHEMA, run
from placeweave.sources import sinks
from placeweave.sources.requests import REQUEST_SCHEMA, require_requests

RUN_REQUEST_SCHEMA = REQUEST_SCHEMA + ", scrape_details BOOLEAN, scrape_emails BOOLEAN"


def requests_from_input(spark: SparkSession, cfg: dict) -> DataFrame:
    """One request row per entry of ``searchQueries`` and of ``startUrls``
    (the input is a short list, built on the driver).  ``request_id`` is the
    entry's position (queries first), stable whatever O1 later drops;
    trimming, blank removal, the 200 cap and defaults are the O1 table job
    inside :func:`run`.  Fails like the reference when nothing is left."""
    from placeweave.sources.requests import normalise_requests

    if not cfg:
        raise ValueError("No input provided")
    queries = [q if isinstance(q, str) else None for q in (cfg.get("searchQueries") or [])]
    urls = [u.get("url") if isinstance(u, dict) else u for u in (cfg.get("startUrls") or [])]
    common = (cfg.get("language"), cfg.get("maxResults"), bool(cfg.get("useMultiSearch", False)),
              cfg.get("searchRegions") or None, cfg.get("scrapeDetails", True), cfg.get("scrapeEmails", True))
    rows = [(i, q, None, *common) for i, q in enumerate(queries)]
    rows += [(len(queries) + i, None, u, *common) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, RUN_REQUEST_SCHEMA)
    require_requests(normalise_requests(df))
    return df


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--input", required=True, help="run-input JSON file")
    ap.add_argument("--pages", required=True, help="captured pages (parquet)")
    ap.add_argument("--out", required=True, help="output folder")
    ap.add_argument("--format", default="parquet", choices=["parquet", "json", "csv", "xml"])
    ap.add_argument("--run-id", help="append under this name: a repeated command replaces its rows (parquet only)")
    ap.add_argument("--cut-lineage", action="store_true", help="checkpoint extracted rows after X1")
    args = ap.parse_args(argv)

    from placeweave.session import get_spark, scratch_path

    spark = get_spark(app="placeweave-run")
    with open(args.input, encoding="utf-8") as fh:
        cfg = json.load(fh)
    res = run(requests_from_input(spark, cfg), spark.read.schema(CAPTURED_PAGE_SCHEMA).parquet(args.pages),
              cut_lineage=args.cut_lineage)
    # extract once: the statistics are counted while the rows are written
    if args.run_id and args.format != "parquet":
        ap.error("--run-id needs --format parquet")
    if args.format == "parquet":
        stats = res.write(f"{args.out}/businesses", run=args.run_id)
    else:
        rows = scratch_path(spark, "run")
        stats = res.write(rows)
        sinks.write_businesses(spark.read.parquet(rows), f"{args.out}/businesses", fmt=args.format)
    sinks.write_errors(res.errors, f"{args.out}/errors")
    sinks.write_stats(stats, f"{args.out}/stats")


if __name__ == "__main__":
    main()
