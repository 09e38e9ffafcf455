"""Registered queries over captured pages that Spark builds from the driver
tables: result pages, detail pages and websites of the customers.

Each page is written in the captured pages' markup, one variant of every rule
per customer key, so the expected values are plain column arithmetic: the
DuckDB twins compute them straight from ``customer`` and ``nation`` and share
no pattern with the extraction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions.arrays import size0
from placeweave.operators import elements as X
from placeweave.operators.details import detail_fields
from placeweave.operators.listing import listings
from placeweave.plans import business_run as PL
from placeweave.plans.registry import register
from placeweave.sources.tables import dealt, load

SITE = "https://m.example"


def key() -> Column:
    return F.col("c_custkey")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pick(selector: Column, *options: Column) -> Column:
    """The option whose number the selector gives (the last one otherwise)."""
    out = options[-1]
    for i, o in reversed(list(enumerate(options[:-1]))):
        out = F.when(selector == i, o).otherwise(out)
    return out


# ---------------------------------------------------------------------------
# Result pages
# ---------------------------------------------------------------------------

def _lat() -> Column:
    return _text("25.", F.lpad((key() % 1000).cast("string"), 3, "0"))


def _link() -> Column:
    """One id rule per ``key % 8``: path, ``!1s``, ``!19s``, link attribute,
    hexadecimal, parent attribute, generated from the name, none."""
    at = _text("!3d", _lat(), "!4d121.5")
    return _pick(
        key() % 8,
        _text('<a href="/maps/place/P/ChIJp', key(), '?hl=en"></a>'),
        _text(f'<a href="{SITE}/maps/place/P/data=!4m1!1sChIJd', key(), "!8m2", at, '"></a>'),
        _text(f'<a href="{SITE}/maps/place/P/data=!4m1!19sChIJg', key(), '?x"></a>'),
        _text('<a data-pid="ChIJa', key(), '" href="/maps/place/P/"></a>'),
        _text('<a href="/maps/place/P/data=!1s0x', F.lower(F.hex(key())), ':0x1"></a>'),
        _text('<span data-pid="ChIJq', key(), '"><a href="/maps/place/P/"></a></span>'),
        _text(f'<a href="{SITE}/maps/place/P/@1,2/data=', at, '"><div>', F.col("c_name"), "</div></a>"),
        F.lit('<a href="/maps/place/P/"></a>'))


def _card() -> Column:
    score = _text((key() % 50 / 10).cast("int"), ".", key() % 10)
    rating = _pick(key() % 4, _text('<span role="img" aria-label="', score, ' stars"></span>'),
                   _text('<span class="MW4etd">', score, "</span>"), F.lit('<span class="MW4etd">.</span>'), F.lit(""))
    n = key() * 7
    count = F.when(n >= 1000, _text((n / 1000).cast("long"), ",", F.lpad((n % 1000).cast("string"), 3, "0"))).otherwise(n.cast("string"))
    blocks = F.when(key() % 5 == 0, _text('<div class="W4Efsd">', F.col("c_mktsegment"), " · ", key(), "區 Road</div>")).otherwise(
        _text('<div class="W4Efsd"><span>4.2</span><span>$$</span></div><div class="W4Efsd"><span>', F.col("c_mktsegment"),
              "</span><span>· ", key(), " Main St</span></div>"))
    phone = F.when(key() % 3 == 0, F.lit("")).otherwise(
        _text("<div>(02) 2345-", F.lpad((key() % 10000).cast("string"), 4, "0"), "</div>"))
    body = _text('<div class="fontHeadlineSmall"> ', F.col("c_name"), "</div>", rating, "<span>(", count, ")</span>", blocks, phone)
    # a card without a name yields no row; a second card of an id is dropped
    shown = F.when((key() % 13 == 0) & (key() % 8 != 6), F.lit("")).otherwise(body)
    again = F.when((key() % 24 == 0) & (key() % 13 != 0), _text(
        '<div jsaction="mouseover:pane.d">', _link(), '<div class="fontHeadlineSmall">Second</div></div>')).otherwise(F.lit(""))
    return _text('<div jsaction="mouseover:pane.c">', _link(), shown, "</div>", again)


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per nation and 500 customer keys (20 cards on average)."""
    cust = dealt(load(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
    cards = cust.select((F.col("c_nationkey") * 1000000 + F.floor(key() / 500)).cast("long").alias("page_id"), key().alias("k"),
                        _card().alias("card"))
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "card"))), lambda c: c["card"]), "")
    return cards.groupBy("page_id").agg(html.alias("cards")).select(
        "page_id", F.lit(f"{SITE}/maps/search/x").alias("url"),
        _text('<html><body><div role="feed">', F.col("cards"), "</div></body></html>").alias("html"))


@register("listings", f"""
WITH c AS (
  SELECT *, c_custkey AS k, CAST(c_nationkey * 1000000 + c_custkey // 500 AS BIGINT) AS page_id,
         '25.' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS lat
  FROM customer
), links AS (
  SELECT *, FALSE AS again FROM c UNION ALL SELECT *, TRUE FROM c WHERE k % 24 = 0 AND k % 13 <> 0
), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k, again) - 1 AS INTEGER) AS pos FROM links
), hashed AS (
  SELECT *, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(c_name || '_' || lat || '_121.5', ''),
                        lambda x: CAST(ord(x) AS BIGINT))), lambda a, b: (a * 31 + b) % 4294967296) AS h
  FROM placed WHERE NOT again AND NOT (k % 13 = 0 AND k % 8 <> 6)
)
SELECT page_id, pos, c_name AS name,
       CASE k % 8 WHEN 0 THEN 'ChIJp' || k WHEN 1 THEN 'ChIJd' || k WHEN 2 THEN 'ChIJg' || k WHEN 3 THEN 'ChIJa' || k
            WHEN 4 THEN 'hex_0x' || printf('%x', k) || ':0x1' WHEN 5 THEN 'ChIJq' || k
            WHEN 6 THEN 'generated_' || lower(to_base(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END), 36))
            ELSE 'fallback_' || page_id || '_' || pos END AS placeId,
       CASE WHEN k % 8 IN (1, 6) THEN CAST(lat AS DOUBLE) END AS latitude,
       CASE WHEN k % 8 IN (1, 6) THEN CAST(121.5 AS DOUBLE) END AS longitude,
       CASE WHEN k % 4 < 2 AND k % 50 > 0
            THEN CAST((k % 50) // 10 || '.' || k % 10 AS DOUBLE) END AS rating,
       k * 7 AS reviews,
       CASE WHEN k % 5 = 0 THEN k || '區 Road' ELSE k || ' Main St' END AS address,
       c_mktsegment AS businessType,
       CASE WHEN k % 3 <> 0 THEN '(02) 2345-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') END AS phone,
       '{SITE}/maps/place/P/' || CASE k % 8 WHEN 0 THEN 'ChIJp' || k || '?hl=en'
            WHEN 1 THEN 'data=!4m1!1sChIJd' || k || '!8m2!3d' || lat || '!4d121.5' WHEN 2 THEN 'data=!4m1!19sChIJg' || k || '?x'
            WHEN 4 THEN 'data=!1s0x' || printf('%x', k) || ':0x1' WHEN 6 THEN '@1,2/data=!3d' || lat || '!4d121.5' ELSE '' END AS url
FROM hashed
""")
def listings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 + L1–L12 + W1 over result pages built from the customers."""
    rows = listings(X.page_elements(result_pages(spark, sf_dir)))
    return rows.select("page_id", "pos", "name", "placeId", "latitude", "longitude", "rating", "reviews", "address",
                       "businessType", "phone", "url")


def fragment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One captured fragment per customer, without ``html`` or ``body`` and with
    the nesting faults that a browser repairs (by ``key % 6``): a bare link
    beside its name; a card inside a table outside its cells; a card that is
    never closed; formatting closed across a block; rows without a table; a
    link closed by the next link."""
    link = _text('<a href="/maps/place/P/ChIJf', key(), '">')
    name = _text('<div class="fontHeadlineSmall">', F.col("c_name"))
    phone = _text("(02) 2345-", F.lpad((key() % 10000).cast("string"), 4, "0"))
    card = '<div jsaction="mouseover:pane.c">'
    html = _pick(
        key() % 6,
        _text(link, "</a>", name, "</div><div>", phone),
        _text("<table>", link, "</a>", name, "</div><tr><td>", phone, "</table>"),
        _text(card, link, "</a><p>", name, "</div><p>", phone),
        _text("<b>", card, link, "</a>", name, "</b></div>", phone, "</div>"),
        _text(card, "<tr><td>", link, "</a></td>", name, "</div></tr>", phone, "</table></div>"),
        _text(card, link, link, "</a>", name, "</div></div>", phone))
    return dealt(load(spark, sf_dir, "customer", "c_custkey", "c_name")).select(
        key().cast("long").alias("page_id"), F.lit(f"{SITE}/maps/search/x").alias("url"), html.alias("html"))


@register("listing_fragments", f"""
SELECT k AS page_id, CAST(0 AS INTEGER) AS pos, c_name AS name, 'ChIJf' || k AS placeId,
       CASE WHEN k % 6 <> 5 THEN '(02) 2345-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') END AS phone,
       '{SITE}/maps/place/P/ChIJf' || k AS url
FROM (SELECT *, c_custkey AS k FROM customer)
""")
def listing_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 + L1–L12 over fragments: a link's ancestors are those that a browser
    gives it.  In the last variant the phone stands outside the card."""
    rows = listings(X.page_elements(fragment_pages(spark, sf_dir)))
    return rows.select("page_id", "pos", "name", "placeId", "phone", "url")


# ---------------------------------------------------------------------------
# Detail pages
# ---------------------------------------------------------------------------

_DAYS_EN = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
_DAYS_ZH = tuple(f"星期{d}" for d in "一二三四五六日")
_ALL_DAY = "24 小時營業"


def detail_html() -> Column:
    """Country by ``key % 4``, hours by ``key // 4 % 4``, price by ``key % 7``."""
    address = _pick(
        key() % 4, _text('<button data-item-id="address" aria-label="Address: ', key(), ' Road, Taiwan"></button>'),
        _text('<button data-item-id="address" aria-label="Address: ', key(), ' Cho, Japan 1000001"></button>'),
        _text('<button aria-label="Address: Street A', key(), ', Seoul, Korea, 04524"></button>'),
        _text('<button data-item-id="address">', key(), "  Hill , , Lane,</button>"))
    phone = _text('<button aria-label="Phone: +886 2 2345 ', F.lpad((key() % 10000).cast("string"), 4, "0"), '"></button>')
    website = F.when(key() % 5 == 0, F.lit("")).otherwise(_text('<a aria-label="Website: s" href="https://site', key(), '.example/">s</a>'))
    opens = _text("0", key() % 9 + 1, ":00–17:00")
    week = _text("<table>", *[x for d in _DAYS_EN for x in (f"<tr><td>{d}</td><td>", opens, "</td></tr>")], "</table>")
    hours = _pick(
        (key() / 4).cast("long") % 4, week,
        F.lit('<button aria-label="Hours">24 hours</button><div class="hours"><ul>'
              f"<li>{_DAYS_ZH[0]}: {_ALL_DAY}</li><li>{_DAYS_ZH[1]}: {_ALL_DAY}</li></ul></div>"),
        F.lit('<button aria-label="Hours: Open 9 AM to 5 PM"></button>'), F.lit(""))
    price = _pick(
        key() % 7, F.lit('<span aria-label="Price level">$$</span>'), F.lit("<div>price <span>·</span></div>"),
        F.lit('<button aria-label="Price: moderate"></button>'), F.lit('<div data-attrid="review">about $$$ here</div>'),
        F.lit("<p>$$</p>"), F.lit("<p>a cheap place</p>"), F.lit(""))
    kind = _text('<button jsaction="pane.category">· ', F.col("c_mktsegment"), "</button>")
    return _text("<html><body>", address, phone, website, hours, price, kind, "</body></html>")


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(load(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")).select(
        key().alias("page_id"), F.lit(f"{SITE}/maps/place/x").alias("url"), detail_html().alias("html"))


_OPENS = "'0' || (k % 9 + 1) || ':00–17:00'"
_LIST_EN = " || ' | ' || ".join(f"'{d}: ' || {_OPENS}" for d in _DAYS_EN)
_LIST_ZH = " | ".join(f"{d}: {_ALL_DAY}" for d in _DAYS_ZH)
_ADDRESS_SQL = """CASE k % 4 WHEN 0 THEN k || ' Road, Taiwan' WHEN 1 THEN k || ' Cho, Japan 〒100-0001'
            WHEN 2 THEN '04524 Street A' || k || ', Seoul, Korea' ELSE k || ' Hill , Lane' END"""
_PHONE_SQL = "'+886 2 2345 ' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0')"
_HOURS_SQL = f"CASE k // 4 % 4 WHEN 0 THEN {_LIST_EN} WHEN 1 THEN '{_LIST_ZH}' WHEN 2 THEN 'Hours: Open 9 AM to 5 PM' END"
_PRICE_SQL = "CASE k % 7 WHEN 0 THEN '$$' WHEN 1 THEN '$' WHEN 2 THEN '$$' WHEN 3 THEN '$$$' WHEN 4 THEN '$$' WHEN 5 THEN '$' END"


@register("detail_fields", f"""
SELECT k AS page_id, {_ADDRESS_SQL} AS address, {_PHONE_SQL} AS phone,
       CASE WHEN k % 5 <> 0 THEN 'https://site' || k || '.example/' END AS website, {_HOURS_SQL} AS hours,
       CAST(CASE WHEN k // 4 % 4 < 2 THEN 7 ELSE 0 END AS INTEGER) AS n_days, {_PRICE_SQL} AS priceLevel, c_mktsegment AS businessType
FROM (SELECT *, c_custkey AS k FROM customer)
""")
def detail_fields_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 + D1–D12 over detail pages built from the customers."""
    d = detail_fields(X.page_elements(detail_pages(spark, sf_dir)))
    return d.select("page_id", "address", "phone", "website", F.array_join("hours", " | ").alias("hours"),
                    size0(F.col("hours_entries")).alias("n_days"), "priceLevel", "businessType")


_JSON_EN = "'{' || " + " || ',' || ".join(f"'\"{d}\":\"' || {_OPENS} || '\"'" for d in _DAYS_EN) + " || '}'"
_JSON_ZH = "{" + ",".join(f'"{d}":"{_ALL_DAY}"' for d in _DAYS_ZH) + "}"


@register("weekly_hours", f"""
SELECT k AS page_id, CAST(CASE WHEN k // 4 % 4 < 2 THEN 7 ELSE 0 END AS INTEGER) AS n_days,
       CASE k // 4 % 4 WHEN 0 THEN {_JSON_EN} WHEN 1 THEN '{_JSON_ZH}' END AS hours_detail
FROM (SELECT c_custkey AS k FROM customer)
""")
def weekly_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 + D1–D3: the weekly day→hours entries of each detail page (week
    table, panel with 24-hour fill, none)."""
    d = detail_fields(X.page_elements(detail_pages(spark, sf_dir)))
    return d.select("page_id", size0(F.col("hours_entries")).alias("n_days"), F.to_json("hoursDetail").alias("hours_detail"))


# ---------------------------------------------------------------------------
# The whole run
# ---------------------------------------------------------------------------

#: Orders whose numbers share this range are what one search found.
_RANGE = 64


def _run(spark: SparkSession, sf_dir: str, cut_lineage: bool = False) -> PL.RunResult:
    """Every range of 64 order numbers is a request, its orders' customers are
    what it found (a page never holds more than its range).  By ``request %
    6``: a search over 7 regions for 60 results; a search for 25, with a stale
    capture beside the newest; a start URL; a start URL that is none; a search
    without a capture; a search whose newest capture has no content (every
    second one has an older capture that has).  Every second customer has a
    captured detail page — of every tenth the newest has no content, of every
    twentieth an older one has — and every fourth a captured website."""
    orders = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    o, r = F.col("o"), F.col("r")
    hits = dealt(orders.select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("k"),
                               F.floor(F.col("o_orderkey") / _RANGE).cast("long").alias("r")), "r")
    case = r % 6
    none, no_id = F.lit(None).cast("string"), F.lit(None).cast("long")
    requests = hits.select("r").distinct().select(
        r.alias("request_id"), F.when(case.isin(2, 3), none).otherwise(_text("find ", r, " ")).alias("query"),
        F.when(case == 2, _text(f"{SITE}/search/w", r, "+x/@1,2")).when(case == 3, _text("word ", r)).alias("source_url"),
        F.when(case == 0, 60).when(case == 2, 10).otherwise(25).alias("max_results"), (case == 0).alias("use_multi"),
        F.lit("en").alias("language"), F.lit(None).cast("array<string>").alias("regions"))

    card = _text('<div jsaction="mouseover:pane.c"><a href="/maps/place/P/ChIJr', F.col("k"), '"></a><div class="fontHeadlineSmall">Place ',
                 F.col("k"), "</div></div>")
    in_region = hits.withColumn("region_pos", F.explode(F.sequence(F.lit(0), F.lit(6)))).where(F.when(
        case == 0, (o % 7 == F.col("region_pos")) | ((o + 3) % 7 == F.col("region_pos"))).otherwise((F.col("region_pos") == 0) & ~case.isin(3, 4)))
    cards = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", card.alias("card")))), lambda c: c["card"]), "")
    now, earlier = F.timestamp_seconds(F.lit(1_700_000_000)), F.timestamp_seconds(F.lit(1_600_000_000))

    def listing(page_id: Column, region, at: Column, html: Column) -> list[Column]:
        return [page_id.alias("page_id"), F.lit("listing").alias("kind"), r.alias("request_id"), region.cast("int").alias("region_pos"),
                none.alias("place_id"), _text(f"{SITE}/maps/search/", r).alias("url"), at.alias("captured_at"), html.alias("html")]

    def other(df: DataFrame, kind: str, page_id: Column, place: Column, url: Column, at: Column, html: Column) -> DataFrame:
        return df.select(page_id.alias("page_id"), F.lit(kind).alias("kind"), no_id.alias("request_id"), F.lit(None).cast("int").alias("region_pos"),
                         place.alias("place_id"), url.alias("url"), at.alias("captured_at"), html.alias("html"))

    found = in_region.groupBy("r", "region_pos").agg(cards.alias("cards"))
    shown = found.where((case != 5) | (r % 12 == 5)).select(*listing(
        r * 10 + F.col("region_pos"), F.col("region_pos"), F.when(case == 5, earlier).otherwise(now), _text('<div role="feed">', F.col("cards"), "</div>")))
    empty = found.where(case == 5).select(*listing(-r - 1, F.lit(0), now, none))
    old = _text('<div jsaction="mouseover:pane.c"><a href="/maps/place/P/ChIJold"></a><div>Old</div></div>')
    stale = found.where(case == 1).select(*listing(-r - 1, F.lit(0), earlier, old))
    cust = dealt(load(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"))
    place, place_url = _text("ChIJr", key()), _text(f"{SITE}/maps/place/", key())
    details = cust.where((key() % 2 == 0) & ((key() % 10 != 0) | (key() % 20 == 0)))
    lost = cust.where(key() % 10 == 0)
    sites = cust.where(key() % 4 == 0)
    mail = _text("<body>Mail INFO", key(), "&#64;shop.test, no-reply@shop.test <a href='mailto:owner", key(), "@shop.test?subject=x'>m</a></body>")
    pages = reduce(DataFrame.unionByName, [
        shown, empty, stale,
        other(details, "detail", key() * 10 + 1, place, place_url, F.when(key() % 20 == 0, earlier).otherwise(now), detail_html()),
        other(lost, "detail", key() * 10 + 2, place, place_url, now, none),
        other(sites, "website", key() * 10 + 3, none, _text("HTTPS://Site", key(), ".example:443#top"), now, mail)])
    return PL.run(requests, pages, run_ts="1970-01-01 00:00:00", cut_lineage=cut_lineage)


_RUN_SQL = f"""
WITH hits AS (
  SELECT o_orderkey AS o, o_custkey AS k, o_orderkey // {_RANGE} AS r FROM orders
), searches AS (
  SELECT DISTINCT r, CASE WHEN r % 6 = 2 THEN 'w' || r || '+x' ELSE 'find ' || r END AS query,
         CASE WHEN r % 6 = 2 THEN '{SITE}/search/w' || r || '+x/@1,2' END AS source_url,
         CASE r % 6 WHEN 0 THEN 60 WHEN 2 THEN 10 ELSE 25 END AS max_results, r % 6 <> 2 AS enrich FROM hits
), in_page AS (
  SELECT r, g AS region_pos, k, min(o) AS o FROM hits, range(7) t(g)
  WHERE CASE WHEN r % 6 = 0 THEN o % 7 = g OR (o + 3) % 7 = g ELSE g = 0 AND (r % 6 IN (1, 2) OR r % 12 = 5) END
  GROUP BY ALL
), extracted AS (
  SELECT p.*, s.query, s.source_url, s.max_results, s.enrich FROM in_page p JOIN searches s USING (r)
  QUALIFY row_number() OVER (PARTITION BY r, region_pos ORDER BY o) <= max_results
), firsts AS (
  SELECT * FROM extracted QUALIFY row_number() OVER (PARTITION BY r, k ORDER BY region_pos, o) = 1
), kept AS (
  SELECT f.*, c_custkey IS NOT NULL AND k % 2 = 0 AS has_page, k % 2 = 0 AND (k % 10 <> 0 OR k % 20 = 0) AS readable,
         enrich AND c_custkey IS NOT NULL AND k % 2 = 0 AND (k % 10 <> 0 OR k % 20 = 0) AS detailed, c_mktsegment
  FROM firsts f LEFT JOIN customer ON c_custkey = k
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY region_pos, o) <= max_results
), business AS (
  SELECT query, source_url, 'Place ' || k AS name, 'ChIJr' || k AS placeId,
         CASE WHEN detailed THEN """ + _PHONE_SQL + """ END AS phone,
         CASE WHEN detailed AND k % 5 <> 0 THEN 'https://site' || k || '.example/' END AS website,
         CASE WHEN detailed THEN """ + _HOURS_SQL + """ END AS hours,
         CASE WHEN detailed THEN """ + _PRICE_SQL + """ END AS priceLevel,
         CASE WHEN detailed THEN c_mktsegment END AS businessType,
         CASE WHEN detailed AND k % 5 <> 0 AND k % 4 = 0 THEN 'info' || k || '@shop.test' END AS email,
         CAST(CASE WHEN detailed AND k % 5 <> 0 THEN CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END END AS INTEGER) AS n_emails
  FROM kept
)
"""


@register("business_rows", _RUN_SQL + "SELECT * FROM business")
def business_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run over searches, start URLs, details and websites built
    from the tables: its business rows."""
    b = _run(spark, sf_dir).businesses
    return b.select("query", "source_url", "name", "placeId", "phone", "website", F.array_join("hours", " | ").alias("hours"),
                    "priceLevel", "businessType", "email",
                    F.when(F.col("emails").isNotNull(), F.size("emails")).alias("n_emails"))


@register("business_errors", f"""
WITH s AS (SELECT DISTINCT o_orderkey // {_RANGE} AS r FROM orders)
SELECT r AS request_id, 'word ' || r AS source_url, 'Invalid URL' AS error FROM s WHERE r % 6 = 3
UNION ALL SELECT r, NULL, 'No captured page for this search' FROM s WHERE r % 6 = 4
UNION ALL SELECT r, '{SITE}/maps/search/' || r, 'No content captured' FROM s WHERE r % 6 = 5
UNION ALL SELECT NULL, '{SITE}/maps/place/' || c_custkey, 'No content captured' FROM customer WHERE c_custkey % 10 = 0
""")
def business_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error rows of the run — start URLs that are none, searches
    without a capture, captures without content."""
    return _run(spark, sf_dir).errors.select("request_id", "source_url", "error")


@register("business_run", _RUN_SQL + """, wanted AS (
  SELECT * FROM kept WHERE enrich
), totals AS (
  SELECT count(*) AS total_searches, count(*) FILTER (WHERE r % 6 IN (3, 4) OR r % 12 = 11) AS failed_searches FROM searches
), counts AS (
  SELECT (SELECT count(*) FROM business) AS total_results, (SELECT count(*) FROM extracted) AS extracted,
         (SELECT CAST(coalesce(sum(n_emails), 0) AS BIGINT) FROM business) AS emails_found,
         (SELECT count(*) FILTER (WHERE has_page AND readable) FROM wanted) AS details_success,
         (SELECT count(*) FILTER (WHERE has_page AND NOT readable) FROM wanted) AS details_failed,
         (SELECT count(*) FILTER (WHERE NOT has_page) FROM wanted) AS details_missing,
         (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT k FROM wanted)) AS details_orphan
)
SELECT total_searches, total_results, failed_searches,
       CAST(floor(total_results / total_searches + 0.5) AS BIGINT) AS avg_results_per_search,
       CAST(floor((total_searches - failed_searches) / total_searches * 100 + 0.5) AS BIGINT) || '%' AS success_rate,
       extracted, emails_found, details_success, details_failed, details_missing, details_orphan, total_results AS final_count
FROM totals, counts
""")
def business_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 statistics of the run with the A2 extraction counters (one row);
    each page is parsed once."""
    return _run(spark, sf_dir, cut_lineage=True).stats
