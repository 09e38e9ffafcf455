"""Registered queries for repeated writes (O5, O6), page bytes (O8), shown text
(X2), long blacklists (J4), numbered violations (V6) and area density (R1).

Inputs are made from the driver tables' keys, so the DuckDB twins state the
results by plain arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions.arrays import size0
from placeweave.operators import elements as X
from placeweave.operators import emails as E
from placeweave.operators import relational as R
from placeweave.operators.details import detail_fields
from placeweave.operators.listing import listings
from placeweave.plans import analyses as AN
from placeweave.plans import metrics as M
from placeweave.plans import quality as V
from placeweave.plans.q_captured import _pick, _text, key
from placeweave.plans.q_checks import null
from placeweave.plans.registry import register
from placeweave.session import scratch_path
from placeweave.sources import runs
from placeweave.sources.pagebytes import decode_pages
from placeweave.sources.tables import dealt, load

# ---------------------------------------------------------------------------
# Runs that are written again
# ---------------------------------------------------------------------------

SUPPLIER_DDL = "s_suppkey BIGINT, s_name STRING, s_acctbal DOUBLE"


@register("append_runs", """
WITH s AS (SELECT *, 'run-' || s_suppkey % 3 AS run FROM supplier)
SELECT s_suppkey, s_name, s_acctbal, run, count(*) OVER (PARTITION BY run) AS rows_written,
       sum(CAST(round(s_acctbal * 100) AS BIGINT)) OVER (PARTITION BY run) AS cents
FROM s
""")
def append_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O5 + O6: three runs are appended; the first is written with rows that
    its retry does not have, the second twice the same, a fourth dies before
    its commit.  What is read is each run once, with the counts of its
    manifest row."""
    path = scratch_path(spark, "append-runs")
    rows = load(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_acctbal")
    cents = {"cents": F.sum(F.round(F.col("s_acctbal") * 100).cast("long"))}
    for run, part in (("run-0", rows), ("run-0", rows.where("s_suppkey % 3 = 0")), ("run-1", rows.where("s_suppkey % 3 = 1")),
                      ("run-2", rows.where("s_suppkey % 3 = 2")), ("run-1", rows.where("s_suppkey % 3 = 1"))):
        runs.append_run(part, path, run, cents)
    runs.write_attempt(rows, path, "run-3", cents)
    counts = runs.manifest(spark, path, rows_written="long", cents="long").select(F.col("run").alias("m_run"), "rows_written", "cents")
    read = runs.read_runs(spark, path, SUPPLIER_DDL)
    return read.join(counts, F.col("run") == F.col("m_run")).drop("m_run")


# ---------------------------------------------------------------------------
# Page bytes
# ---------------------------------------------------------------------------

#: How the pages are encoded, by customer key: (codec, what the page says).
_ENCODINGS = (("utf-8", '<meta charset="utf-8">'), ("big5", '<meta charset=Big5>'),
              ("shift_jis", '<meta http-equiv="Content-Type" content="text/html; charset=Shift_JIS">'),
              ("euc-kr", "<meta charset='euc-kr'>"), ("utf-16-le", ""), ("utf-8", ""), ("latin-1", '<META CHARSET="ISO-8859-1">'),
              ("cp1252", ""))
_NAMES = ("台北咖啡", "臺中餐廳", "東京カフェ", "서울식당", "上海饭店", "Zürich café", "Málaga", "Crème brûlée")


def page_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per customer as bytes: eight encodings, some declared, one with
    a byte order mark, some to be guessed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in batch.column("page_id").to_pylist():
                codec, said = _ENCODINGS[k % 8]
                html = f'<head>{said}</head><a href="/maps/place/P/ChIJb{k}"></a><div class="fontHeadlineSmall">{_NAMES[k % 8]} {k}</div>'
                out.append((b"\xff\xfe" if codec == "utf-16-le" else b"") + html.encode(codec))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.binary())],
                                             names=["page_id", "url", "content"])
    ids = dealt(load(spark, sf_dir, "customer", "c_custkey")).select(key().cast("long").alias("page_id"), _text("https://m.example/", key()).alias("url"))
    return ids.mapInArrow(run, "page_id long, url string, content binary")


_CASES = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES))


@register("decoded_pages", f"""
SELECT CAST(c_custkey AS BIGINT) AS page_id, CASE c_custkey % 8 {_CASES} END || ' ' || c_custkey AS name,
       CASE c_custkey % 8 WHEN 1 THEN 'big5hkscs' WHEN 2 THEN 'cp932' WHEN 3 THEN 'cp949' WHEN 4 THEN 'utf-16-le'
            WHEN 6 THEN 'windows-1252' WHEN 7 THEN 'windows-1252' ELSE 'utf-8' END AS charset
FROM customer
""")
def decoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O8 + X1: names read from page bytes in eight encodings."""
    pe = X.page_elements(decode_pages(page_bytes(spark, sf_dir)), carry=("charset",))
    name = X.text_of(F.try_element_at(F.filter("elements", lambda e: e["tag"] == "div"), F.lit(1)))
    return pe.select("page_id", name.alias("name"), "charset")


# ---------------------------------------------------------------------------
# What a page shows
# ---------------------------------------------------------------------------

def hidden_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A website per customer with an address that is shown and one that is
    not, hidden in another way by each remainder of six."""
    hidden = _text("trap", key(), "@shop.test")
    way = _pick(key() % 6, _text('<div style="display:none">', hidden, "</div>"), _text("<p hidden>", hidden, "<p>"),
                _text('<ul style="color:red; VISIBILITY : hidden"><li><b>', hidden, "</b></ul>"),
                _text("<table><tr><td>x<tr style='display: none !important'><td>", hidden, "</table>"),
                _text("<template>", hidden, "</template><noscript>", hidden, "</noscript>"),
                _text('<div hidden><div>', hidden, "</div>", hidden, '</div><a href="mailto:link', key(), '@shop.test" hidden>m</a>'))
    html = _text("<body><h1>Shop</h1>", way, "<div>mail", key(), "@shop.test</div><div>next</div></body>")
    return dealt(load(spark, sf_dir, "customer", "c_custkey")).select(
        key().cast("long").alias("page_id"), _text("https://shop", key(), ".test/").alias("url"), html.alias("html"))


@register("shown_emails", """
SELECT CAST(c_custkey AS BIGINT) AS page_id, 'mail' || c_custkey || '@shop.test' ||
       CASE WHEN c_custkey % 6 = 5 THEN ',link' || c_custkey || '@shop.test' ELSE '' END AS emails
FROM customer
""")
def shown_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 + E2–E6: addresses in hidden elements are none."""
    return E.shown_page_emails(hidden_pages(spark, sf_dir)).select("page_id", F.array_join("emails", ",").alias("emails"))


# ---------------------------------------------------------------------------
# A blacklist that is a table
# ---------------------------------------------------------------------------

@register("blacklisted_contacts", """
WITH m AS (
  SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN 'Info' || c_custkey || '@shop' || c_custkey % 400 || '.test' END AS email FROM customer
), words AS (
  SELECT lower('@SHOP' || s_suppkey || '.') AS w FROM supplier WHERE s_suppkey % 2 = 0
  UNION SELECT lower('o' || s_suppkey || '3') FROM supplier WHERE s_suppkey % 3 = 0
)
SELECT c_custkey, email FROM m WHERE NOT EXISTS (SELECT 1 FROM words WHERE contains(lower(email), w)) OR email IS NULL
""")
def blacklisted_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' addresses without those that contain a word of a list
    made from the suppliers."""
    cust = load(spark, sf_dir, "customer", "c_custkey")
    mail = cust.select("c_custkey", F.when(key() % 7 != 0, _text("Info", key(), "@shop", key() % 400, ".test")).alias("email"))
    s = F.col("s_suppkey")
    supp = load(spark, sf_dir, "supplier", "s_suppkey")
    words = (supp.where(s % 2 == 0).select(_text("@SHOP", s, ".").alias("word"))
             .unionByName(supp.where(s % 3 == 0).select(_text("o", s, "3").alias("word")))
             .unionByName(supp.limit(1).select(null().alias("word"))))
    return R.anti_match_table(mail, "email", words, "word")


# ---------------------------------------------------------------------------
# V6: violations by row number
# ---------------------------------------------------------------------------

@register("violations_in_order", """
WITH n AS (
  SELECT *, row_number() OVER (ORDER BY c_mktsegment DESC, c_custkey) - 1 AS row_index FROM customer
)
SELECT CAST(row_index AS BIGINT) AS row_index, 'placeId' AS field, CASE c_custkey % 6 WHEN 4 THEN 'ChIJ' || c_custkey || '?x' END AS value
FROM n WHERE c_custkey % 6 >= 4
UNION ALL SELECT row_index, 'phone', '200-400' FROM n WHERE c_custkey % 3 = 0
""")
def violations_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: failed checks by the number of their row in a list by segment."""
    cust = load(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    rows = cust.select(
        key().alias("k"), "c_mktsegment",
        _pick(key() % 6, _text("ChIJ", key()), _text("hex_0x", key()), _text("generated_", key()), _text("fallback_", key()),
              _text("ChIJ", key(), "?x"), null()).alias("placeId"),
        _pick(key() % 3, F.lit("200-400"), F.lit("+886 2 2345 6789"), null()).alias("phone"))
    return V.violations_in_order(rows, F.col("c_mktsegment").desc(), F.col("k"))


# ---------------------------------------------------------------------------
# Density by area
# ---------------------------------------------------------------------------

def _coordinates() -> tuple[Column, Column]:
    """Two customers of three in a town, the others over the country."""
    k = key()
    lat = F.when(k % 3 > 0, 25.03 + (k * 37 % 1000) / 10000.0).otherwise(22.0 + (k * 7919 % 3000) / 1000.0)
    lng = F.when(k % 3 > 0, 121.5 + (k * 53 % 1000) / 10000.0).otherwise(120.0 + (k * 104729 % 2000) / 1000.0)
    return lat, lng


_XY_SQL = """
  SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 25.03::DOUBLE + (c_custkey * 37 % 1000) / 10000.0::DOUBLE
                         ELSE 22.0::DOUBLE + (c_custkey * 7919 % 3000) / 1000.0::DOUBLE END AS lat,
         CASE WHEN c_custkey % 3 > 0 THEN 121.5::DOUBLE + (c_custkey * 53 % 1000) / 10000.0::DOUBLE
              ELSE 120.0::DOUBLE + (c_custkey * 104729 % 2000) / 1000.0::DOUBLE END AS lng
  FROM customer
"""


@register("area_density", f"""
WITH c AS ({_XY_SQL}
), fine AS (
  SELECT CAST(floor((lng + 180.0::DOUBLE) / 360.0::DOUBLE * 65536) AS BIGINT) AS x, CAST(floor((lat + 90.0::DOUBLE) / 180.0::DOUBLE * 65536) AS BIGINT) AS y FROM c
), cells AS (
  SELECT CAST(l AS INTEGER) AS level, x // (1 << (16 - l)) AS cell_x, y // (1 << (16 - l)) AS cell_y, count(*) AS n FROM fine, range(17) t(l) GROUP BY ALL
)
SELECT a.level, a.cell_x, a.cell_y, a.n
FROM cells a LEFT JOIN cells p ON p.level = a.level - 1 AND p.cell_x = a.cell_x // 2 AND p.cell_y = a.cell_y // 2
WHERE (a.n <= 20 OR a.level = 16) AND (a.level = 0 OR p.n > 20)
""")
def area_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per area, in cells of at most 20 where they lie apart."""
    lat, lng = _coordinates()
    cust = load(spark, sf_dir, "customer", "c_custkey").select(lat.alias("lat"), lng.alias("lng"))
    return AN.area_density(cust, "lat", "lng", most=20)


@register("grid_density", f"""
WITH c AS ({_XY_SQL}
), g AS (
  SELECT 's' || c_custkey % 3 AS kind, CAST(floor(lat / 0.5::DOUBLE) AS BIGINT) || ':' || CAST(floor(lng / 0.5::DOUBLE) AS BIGINT) AS cell FROM c
)
SELECT CASE WHEN GROUPING(kind) = 1 THEN 'ALL' ELSE kind END AS kind, CASE WHEN GROUPING(cell) = 1 THEN 'ALL' ELSE cell END AS cell, count(*) AS n
FROM g GROUP BY CUBE (kind, cell)
""")
def grid_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain grid of half degrees, by kind and cell."""
    lat, lng = _coordinates()
    cust = load(spark, sf_dir, "customer", "c_custkey").select(lat.alias("lat"), lng.alias("lng"), _text("s", key() % 3).alias("kind"))
    return AN.density(cust, ["kind"], lat="lat", lng="lng", cell_deg=0.5)


# ---------------------------------------------------------------------------
# Rules that only odd pages reach: D2, D6, D7, D12; L8, L9; A8 end to end
# ---------------------------------------------------------------------------

def odd_detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By ``key % 8``: a panel that is a table; an empty panel beside a week
    table; hours among facilities, with and without a main word; a status line;
    star classes after no, a too long and a booking button."""
    button = '<button aria-label="Hours">x</button>'
    body = _pick(
        key() % 8,
        _text(button, '<table class="hour"><tr><td>週一 (holiday)<td>9:00–17:00<tr><td>Feast ', key(), "<td>8:00–9:00<tr><td>複製營業時間<td>z</table>"),
        _text(button, '<table class="hour"></table><table><tr><td>Monday<td>1', key() % 9, ":00</table>"),
        _text("<div>Pool 7:00 AM – 9:00 PM</div><div>8:00 AM – 5:00 PM</div><div>Daily ", key(), "  6:00 AM – 7:00 PM</div>"),
        _text("<span>Gym 5:00 AM</span><span>1:0", key() % 10, " PM</span>"),
        _text("<p>Shop </p><div><span>Open</span> ⋅ until ", key(), "</div>"),
        _text("<span>", key() % 5 + 1, " 星級飯店</span>"),
        _text('<button jsaction="pane.category">', F.lit("x" * 60), "</button><span>· ", key() % 5 + 1, " 星級</span>"),
        F.lit('<button jsaction="pane.category">選取日期</button>'))
    return dealt(load(spark, sf_dir, "customer", "c_custkey")).select(
        key().cast("long").alias("page_id"), F.lit("https://m.example/maps/place/x").alias("url"), body.alias("html"))


@register("detail_branches", """
SELECT CAST(k AS BIGINT) AS page_id,
       CASE k % 8 WHEN 0 THEN '週一: 9:00–17:00 | Feast ' || k || ': 8:00–9:00' WHEN 2 THEN 'Daily ' || k || ' 6:00 AM – 7:00 PM'
            WHEN 3 THEN '1:0' || k % 10 || ' PM' WHEN 4 THEN 'Shop Open ⋅ until ' || k END AS hours,
       CAST(CASE k % 8 WHEN 0 THEN 2 ELSE 0 END AS INTEGER) AS n_days,
       CASE k % 8 WHEN 5 THEN (k % 5 + 1) || ' 星級飯店' WHEN 6 THEN (k % 5 + 1) || ' 星級' END AS businessType
FROM (SELECT c_custkey AS k FROM customer)
""")
def detail_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2, D6, D7, D12 where they decide."""
    d = detail_fields(X.page_elements(odd_detail_pages(spark, sf_dir)))
    return d.select("page_id", F.array_join("hours", " | ").alias("hours"), size0(F.col("hours_entries")).alias("n_days"), "businessType")


def odd_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One card per page, by ``key % 4``: several blocks with types; several
    addresses; addresses of one length; an address behind a dot."""
    block, end = '<div class="W4Efsd"><span>', "</span></div>"
    blocks = _pick(
        key() % 4,
        _text(block, "Cafe", end, block, F.col("c_mktsegment"), end, block, "$$", end),
        _text(block, "1 A St</span><span>22 Longer Street ", key(), end, block, "3 B", end),
        _text(block, "11 Aa Rd", "</span><span>22 Bb Rd", end),
        _text(block, "· 12 Main St ", key(), end))
    card = _text('<div jsaction="mouseover:pane.c"><a href="/maps/place/P/ChIJo', key(), '"></a><div class="fontHeadlineSmall">', F.col("c_name"),
                 "</div>", blocks, "</div>")
    return dealt(load(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")).select(
        key().cast("long").alias("page_id"), F.lit("https://m.example/maps/search/x").alias("url"), card.alias("html"))


@register("listing_branches", """
SELECT CAST(k AS BIGINT) AS page_id, c_name AS name,
       CASE k % 4 WHEN 1 THEN '22 Longer Street ' || k WHEN 2 THEN '22 Bb Rd' WHEN 3 THEN '12 Main St ' || k END AS address,
       CASE k % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN '3 B' WHEN 2 THEN '11 Aa Rd' END AS businessType
FROM (SELECT *, c_custkey AS k FROM customer)
""")
def listing_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last block with a type decides; L9: the longest address, of
    equals the last of its block."""
    rows = listings(X.page_elements(odd_cards(spark, sf_dir)))
    return rows.select("page_id", "name", "address", "businessType")


@register("end_to_end_verdicts", f"""
WITH e AS (SELECT 'user ' || user_id AS query, event_type FROM events)
SELECT query, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failures,
       CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'pass'
            WHEN count(*) FILTER (WHERE event_type <> 'error') / count(*) >= {M.PARTIAL_RATE} THEN 'partial' ELSE 'fail' END AS band
FROM e GROUP BY query
""")
def end_to_end_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band of every user's runs."""
    return M.end_to_end_verdict(M.run_log_from_events(load(spark, sf_dir, "events")), "query")
