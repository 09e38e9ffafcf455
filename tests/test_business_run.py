"""End-to-end run over fixture requests and captured pages."""

import datetime as dt
import os

import pytest

from placeweave.plans import business_run as PL
from test_details import TW

HERE = os.path.dirname(__file__)
REQ_SCHEMA = ("request_id BIGINT, query STRING, source_url STRING, language STRING, max_results INT, "
              "use_multi BOOLEAN, regions ARRAY<STRING>, scrape_details BOOLEAN, scrape_emails BOOLEAN")


def card(name, href, extra=""):
    return (f'<div class="Nv2PK" jsaction="mouseover:pane.c"><a href="{href}"></a>'
            f'<div class="fontHeadlineSmall">{name}</div>{extra}</div>')


def listing(*cards):
    return '<html><body><div role="feed">' + "".join(cards) + "</div></body></html>"


BAR = card("Bar Two", "https://www.google.com/maps/place/Bar/data=!1s0x3442abb6:0x1f2!3d25.1!4d121.2")
PUB = card("Pub Three", "https://www.google.com/maps/place/Pub/ChIJppp")
PIZZA = card("Pizza Place", "https://www.google.com/maps/place/Pizza/ChIJzza")
SITE = ('<html><body><p>Mail INFO@shop.tw or sales@shop.tw</p><a href="mailto:info@shop.tw?subject=x">x</a>'
        '<a href="mailto:owner@shop.tw">o</a></body></html>')


@pytest.mark.parametrize("cut_lineage", [False, True])
def test_business_run(spark, cut_lineage):
    with open(os.path.join(HERE, "fixtures", "listing_page.html"), encoding="utf-8") as fh:
        cafe = fh.read()
    requests = spark.createDataFrame([
        (1, "cafe taipei", None, "en", 2, False, None, True, True),
        (2, "bar", None, "en", 60, True, ["", "North"], False, True),
        (3, None, "https://www.google.com/maps/search/pizza+taipei/@25,121", "en", 10, False, None, True, True),
        (4, "missing", None, "en", 10, False, None, True, True),
        (5, "   ", None, "en", 10, False, None, True, True),
    ], REQ_SCHEMA)
    t = dt.datetime(2024, 1, 1)
    pages = spark.createDataFrame([
        (101, "listing", 1, 0, None, "https://www.google.com/maps/search/cafe+taipei", t, cafe),
        (102, "listing", 2, 0, None, "https://www.google.com/maps/search/bar", t, listing(BAR)),
        (103, "listing", 2, 1, None, "https://www.google.com/maps/search/bar+North", t, listing(BAR, PUB)),
        (104, "listing", 3, 0, None, "https://www.google.com/maps/search/pizza+taipei", t, listing(PIZZA)),
        (201, "detail", None, None, "ChIJaaa111", "https://www.google.com/maps/place/x", t, TW),
        (202, "detail", None, None, "ChIJzza", "https://www.google.com/maps/place/p", t, TW),
        (203, "detail", None, None, "hex_0x3442abb6:0x1f2", "https://www.google.com/maps/place/b", t,
         '<html><body><a aria-label="Website: bar.test" href="https://bar.test/">bar</a></body></html>'),
        (204, "detail", None, None, "ChIJppp", "https://www.google.com/maps/place/q", t,
         '<html><body><a aria-label="Website" href="https://www.google.com/x">g</a></body></html>'),
        (301, "website", None, None, None, "https://shop.tw/?utm=1", t, SITE),
    ], PL.CAPTURED_PAGE_SCHEMA)
    res = PL.run(requests, pages, run_ts="2024-01-02 03:04:05", cut_lineage=cut_lineage)
    got = {(r.query, r.placeId): r for r in res.businesses.collect()}
    assert set(got) == {("cafe taipei", "ChIJaaa111"), ("cafe taipei", "hex_0x3442abb6:0x1f2"),
                        ("bar", "hex_0x3442abb6:0x1f2"), ("bar", "ChIJppp"), ("pizza+taipei", "ChIJzza")}
    cafe1 = got[("cafe taipei", "ChIJaaa111")]
    assert cafe1.address == "No. 7, Sec. 5, Xinyi Rd, Xinyi District, Taipei City, Taiwan 110"
    assert cafe1.phone == "02-2345-6789" and cafe1.priceLevel == "$$" and cafe1.businessType == "Coffee shop"
    assert cafe1.website == "https://shop.tw/?utm=1"
    assert cafe1.emails == ["info@shop.tw", "sales@shop.tw", "owner@shop.tw"] and cafe1.email == "info@shop.tw"
    assert len(cafe1.hours) == 7 and cafe1.hoursDetail["Monday"] == "09:00–18:00"
    bar = got[("cafe taipei", "hex_0x3442abb6:0x1f2")]
    assert bar.website == "https://bar.test/" and bar.email is None and bar.emails == []   # fetch failed
    pub = got[("bar", "ChIJppp")]
    assert pub.website is None and pub.hours is None          # scrape_details off
    pizza = got[("pizza+taipei", "ChIJzza")]
    assert pizza.source_url.startswith("https://www.google.com/maps/search/pizza+taipei")
    assert pizza.address is None and pizza.hours is None       # URL rows are never enriched
    assert res.businesses.columns == list(PL.BUSINESS_COLUMNS)

    # invariants: one row per (query, place), W3 bound, email = emails[0]
    from pyspark.sql import functions as F
    assert res.businesses.groupBy("query", "placeId").count().filter("count > 1").count() == 0
    per_query = {r.query: r.n for r in res.businesses.groupBy("query").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per_query["cafe taipei"] <= 2 and per_query["bar"] <= 60
    assert res.businesses.filter(F.size("emails") > 0).filter(F.col("email") != F.col("emails")[0]).count() == 0

    errors = res.errors.collect()
    assert [(e.request_id, e.query) for e in errors] == [(4, "missing")]
    stats = res.stats.first()
    assert (stats.total_searches, stats.total_results, stats.failed_searches,
            stats.avg_results_per_search, stats.success_rate) == (4, 5, 1, 1, "75%")
    assert (stats.extracted, stats.final_count, stats.emails_found) == (6, 5, 3)      # "Bar Two" was found in two regions
    # Pizza is never enriched and the bar search wanted no details: their pages are orphans
    assert [stats[c] for c in PL.DETAIL_OUTCOMES] == [2, 0, 0, 2]


def test_unreadable_pages_count_as_failures(spark, tmp_path):
    """Every outcome of a detail page; searches fail that have no
    readable capture; the figures counted while writing equal those of the
    written rows."""
    t = dt.datetime(2024, 1, 1)
    later = dt.datetime(2024, 1, 2)
    requests = spark.createDataFrame([(i, f"q{i}", None, "en", 10, False, None, True, True) for i in range(1, 6)], REQ_SCHEMA)
    cards = [card(f"P{i}", f"https://m.test/maps/place/X/ChIJp{i}") for i in range(4)]
    site = "https://m.test/maps/search/x"
    pages = spark.createDataFrame([
        (1, "listing", 1, 0, None, site, t, listing(*cards)),
        (2, "listing", 2, 0, None, site, later, None),                       # the newest has no content, the older one has
        (3, "listing", 2, 0, None, site, t, listing(cards[0], cards[3])),
        (4, "listing", 3, 0, None, site, t, None),                           # never readable
        (5, "listing", 4, 0, None, site, t, listing()),                      # readable, shows nothing
        (11, "detail", None, None, "ChIJp0", "d0", t, TW),
        (12, "detail", None, None, "ChIJp1", "d1", t, None),
        (13, "detail", None, None, "ChIJp2", "d2", later, None),
        (14, "detail", None, None, "ChIJp2", "d2", t, TW),                   # an older capture can be read
        (15, "detail", None, None, "ChIJother", "dx", t, TW),
        (16, "detail", None, None, None, "dn", t, TW),
        (21, "website", None, None, None, "https://gone.test/", t, None),
    ], PL.CAPTURED_PAGE_SCHEMA)
    res = PL.run(requests, pages, run_ts="2024-01-02 03:04:05", cut_lineage=True)
    stats = res.write(str(tmp_path / "rows")).first()
    # P0 in two searches: 2 rows enriched, and P2; P1 unreadable; P3 (two rows) never captured
    assert [stats[c] for c in PL.DETAIL_OUTCOMES] == [3, 1, 2, 2]
    assert (stats.total_searches, stats.failed_searches, stats.success_rate) == (5, 2, "60%")
    assert (stats.extracted, stats.total_results, stats.final_count) == (6, 6, 6)
    assert stats == res.stats_of(spark.read.parquet(str(tmp_path / "rows"))).first() == res.stats.first()
    got = {(r.request_id, r.source_url, r.error) for r in res.errors.collect()}
    no = "No content captured"
    assert got == {(5, None, "No captured page for this search"), (2, site, no), (3, site, no), (None, "d1", no), (None, "d2", no),
                   (None, "https://gone.test/", no)}


def test_cli_run(spark, tmp_path):
    import json as _json

    from placeweave import cli

    cfg = {"searchQueries": [" bar ", "", None], "startUrls": [{"url": "https://www.google.com/maps/search/pizza"}],
           "maxResults": 500, "useMultiSearch": True, "searchRegions": ["", "North"], "scrapeDetails": False}
    req = {r.request_id: r for r in cli.requests_from_input(spark, cfg).collect()}
    assert set(req) == {0, 1, 2, 3} and req[0].query == " bar " and req[3].source_url.endswith("/pizza")
    assert req[2].query is None
    t = dt.datetime(2024, 1, 1)
    pages = spark.createDataFrame([
        (1, "listing", 0, 0, None, "https://www.google.com/maps/search/bar", t, listing(BAR)),
        (2, "listing", 0, 1, None, "https://www.google.com/maps/search/bar+North", t, listing(BAR, PUB)),
        (3, "listing", 3, 0, None, "https://www.google.com/maps/search/pizza", t, listing(PIZZA)),
    ], PL.CAPTURED_PAGE_SCHEMA)
    pages.write.parquet(str(tmp_path / "pages"))
    (tmp_path / "input.json").write_text(_json.dumps(cfg))
    cli.main(["--input", str(tmp_path / "input.json"), "--pages", str(tmp_path / "pages"),
              "--out", str(tmp_path / "out"), "--format", "json"])
    out = spark.read.json(str(tmp_path / "out" / "businesses"))
    assert sorted((r.query, r.placeId) for r in out.collect()) == [
        ("bar", "ChIJppp"), ("bar", "hex_0x3442abb6:0x1f2"), ("pizza", "ChIJzza")]
    assert spark.read.json(str(tmp_path / "out" / "stats")).first().total_searches == 2
    # a command that is repeated under the name of its run adds nothing
    from placeweave.sources import runs
    ddl = ", ".join(f"`{c}` {PL.BUSINESS_TYPES[c]}" for c in PL.BUSINESS_COLUMNS)
    for _ in range(2):
        cli.main(["--input", str(tmp_path / "input.json"), "--pages", str(tmp_path / "pages"), "--out", str(tmp_path / "again"),
                  "--run-id", "monday"])
    again = runs.read_runs(spark, str(tmp_path / "again" / "businesses"), ddl)
    assert again.count() == 3 and {r.run for r in again.collect()} == {"monday"}
    assert spark.read.json(str(tmp_path / "again" / "stats")).first().total_results == 3


def test_input_without_searches_fails(spark):
    from placeweave import cli

    with pytest.raises(ValueError, match="searchQueries or startUrls"):
        cli.requests_from_input(spark, {"searchQueries": ["  ", None], "startUrls": []})
    with pytest.raises(ValueError, match="No input"):
        cli.requests_from_input(spark, {})
