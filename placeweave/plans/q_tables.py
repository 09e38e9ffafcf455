"""Registered queries over the relational driver tables: requests (O1–O3,
J1), dedupe and limits (W1–W4, U1, U2), enrich joins (J2, J3, D13), run
metrics (A1, A3–A8), quality checks (V1–V7), place ids (L1–L4), hours (D4,
R5) and analyses (R1–R4, R6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeweave.functions import text as T
from placeweave.operators import hours as H
from placeweave.operators import pages as P
from placeweave.operators import placeids as L
from placeweave.operators import relational as R
from placeweave.operators.phones import first_phone_expr
from placeweave.plans import analyses as AN
from placeweave.plans import metrics as M
from placeweave.plans import quality as V
from placeweave.plans import sqlgen as S
from placeweave.plans.registry import register
from placeweave.sources import requests as RQ
from placeweave.sources.tables import load

# ---------------------------------------------------------------------------
# Requests: O1 O2 O3 J1
# ---------------------------------------------------------------------------

_REGIONS_SQL = "[" + ", ".join(S.q(r) for r in RQ.DEFAULT_REGIONS) + "]"


def _encode_uri_sql(x: str) -> str:
    e = f"url_encode({x})"
    for enc, ch in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        e = f"replace({e}, {S.q(enc)}, {S.q(ch)})"
    return e


@register("request_urls", f"""
WITH req AS (
  SELECT p_partkey AS request_id, {S.js_trim('p_name')} AS base_query, 'en' AS language,
         CAST(least(p_size * 10, 200) AS INTEGER) AS max_results, p_size > 25 AS use_multi
  FROM part WHERE p_name IS NOT NULL AND {S.js_trim('p_name')} <> ''),
ex AS (
  SELECT request_id, base_query, language, max_results,
         unnest(r) AS region, CAST(generate_subscripts(r, 1) - 1 AS INTEGER) AS region_pos
  FROM (SELECT *, CASE WHEN use_multi AND max_results > 50 THEN {_REGIONS_SQL} ELSE [''] END AS r FROM req)),
q AS (
  SELECT request_id, region_pos, max_results,
         CASE WHEN region <> '' THEN base_query || ' ' || region ELSE base_query END AS query, language
  FROM ex)
SELECT request_id, 'query' AS kind, region_pos, max_results, query,
       {S.q(RQ.SEARCH_BASE)} || {_encode_uri_sql('query')} || '?hl=' || language AS search_url,
       {S.rlike('query', r'[^\x00-\x7F]')} AS non_ascii
FROM q
UNION ALL
SELECT request_id, 'url', 0, 100, label, search_url, regexp_matches(label, '[^\\x00-\\x7F]') FROM (
  SELECT page_id AS request_id, CASE WHEN page_id % 2 = 0 THEN word ELSE 'Direct URL' END AS label,
         CASE WHEN page_id % 2 = 0 THEN 'https://maps.example/search/' || {_encode_uri_sql('word')} || '/@25,121' ELSE url END AS search_url
  FROM (SELECT page_id, url, split_part(regexp_extract(html, '<title>([^<]*)', 1), ' ', 1) || '+x' AS word FROM pages))
""")
def request_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part name as a search request (``p_size·10``
    results, multi-region when ``p_size > 25``) expanded over regions with its
    search URL; every page as a URL request — a direct URL, or a search URL whose label is
    its decoded query (O2)."""
    parts = load(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    req = parts.select(
        F.col("p_partkey").alias("request_id"), F.col("p_name").alias("query"),
        F.lit(None).cast("string").alias("source_url"), F.lit("en").alias("language"),
        (F.col("p_size") * 10).cast("int").alias("max_results"), (F.col("p_size") > 25).alias("use_multi"),
        F.lit(None).cast("array<string>").alias("regions"))
    expanded = RQ.with_search_url(RQ.expand_regions(RQ.normalise_requests(req)))
    q = expanded.select("request_id", F.lit("query").alias("kind"), F.col("region_pos").cast("int"),
                        "max_results", "query", "search_url", "non_ascii")
    # every second page is reached through a search URL for its title's first word
    pages = load(spark, sf_dir, "pages", "page_id", "url", "html")
    word = F.concat(F.substring_index(F.regexp_extract("html", "<title>([^<]*)", 1), " ", 1), F.lit("+x"))
    search = F.concat(F.lit("https://maps.example/search/"), RQ.uri_component(word), F.lit("/@25,121"))
    urls = RQ.requests_from_urls(pages.select(
        "page_id", F.when(F.col("page_id") % 2 == 0, search).otherwise(F.col("url")).alias("url")))
    u = urls.select(F.col("page_id").alias("request_id"), F.lit("url").alias("kind"),
                    F.lit(0).alias("region_pos"), F.lit(100).alias("max_results"), "query",
                    F.col("url").alias("search_url"), F.col("query").rlike(r"[^\x00-\x7F]").alias("non_ascii"))
    return q.unionByName(u)


# ---------------------------------------------------------------------------
# Dedupe, limits, unions: W1–W4, U1, U2
# ---------------------------------------------------------------------------

def _ts_text(col: str) -> F.Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _ts_text_sql(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f')"


@register("dedupe_first_wins", f"""
SELECT user_id, event_type, event_id, {_ts_text_sql('ts')} AS first_ts, value
FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1
""")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event per (user, type) by (ts, event_id) — first-wins."""
    ev = load(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    first = R.dedupe_first(ev, ["user_id", "event_type"], ["ts", "event_id"])
    return first.select("user_id", "event_type", "event_id", _ts_text("ts").alias("first_ts"), "value")


TOP_N = 5


@register("top_n_per_query", f"""
SELECT user_id, event_id, CAST(rn AS INTEGER) AS rank, event_type
FROM (SELECT user_id, event_id, event_type,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
WHERE rn <= {TOP_N}
""")
def top_n_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five events of each user (the user is the query) in time
    order."""
    ev = load(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    top = R.limit_per_query(ev, "user_id", ["ts", "event_id"], limit=TOP_N, rank_col="rank")
    return top.select("user_id", "event_id", F.col("rank").cast("int"), "event_type")


REGION_MAX = 60

# A captured result of a nation's search in region r: customers with key % 7 = r
# or key % 5 = r, so neighbouring regions overlap.


@register("region_expansion", f"""
WITH req AS (
  SELECT n_nationkey AS request_id, n_name AS base_query, n_nationkey, unnest({_REGIONS_SQL}) AS region,
         CAST(generate_subscripts({_REGIONS_SQL}, 1) - 1 AS INTEGER) AS region_pos
  FROM nation),
hits AS (
  SELECT r.base_query, r.region_pos, c.c_custkey AS placeId, c.c_name AS name
  FROM req r JOIN customer c ON c.c_nationkey = r.n_nationkey
   AND (c.c_custkey % 7 = r.region_pos OR c.c_custkey % 5 = r.region_pos)),
firsts AS (SELECT base_query, min(region_pos) AS region_pos, placeId, name FROM hits GROUP BY base_query, placeId, name)
SELECT base_query, region_pos, placeId, name
FROM firsts
QUALIFY row_number() OVER (PARTITION BY base_query ORDER BY region_pos, placeId) <= {REGION_MAX}
""")
def region_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation name is a multi-region search over the
    7 default regions; the captured results of all its regions are unioned,
    de-duplicated first-wins across regions and cut to the request's
    ``max_results`` of 60."""
    nation = load(spark, sf_dir, "nation", "n_nationkey", "n_name")
    req = nation.select(F.col("n_nationkey").alias("request_id"), F.col("n_name").alias("query"),
                        "n_nationkey", F.lit(REGION_MAX).alias("max_results"), F.lit(True).alias("use_multi"))
    expanded = RQ.expand_regions(req)
    cust = load(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    in_region = (F.col("c_custkey") % 7 == F.col("region_pos")) | (F.col("c_custkey") % 5 == F.col("region_pos"))
    hits = expanded.join(cust, (expanded["n_nationkey"] == cust["c_nationkey"]) & in_region).select(
        "base_query", F.col("region_pos").cast("int"), F.col("c_custkey").alias("placeId"), F.col("c_name").alias("name"),
        "max_results")
    firsts = R.dedupe_first(hits, ["base_query", "placeId"], ["region_pos"])
    top = R.limit_per_query(firsts, "base_query", ["region_pos", "placeId"], limit="max_results", bound=REGION_MAX)
    return top.select("base_query", "region_pos", "placeId", "name")


@register("union_sources", """
SELECT 'c' || CAST(c_custkey AS VARCHAR) AS placeId, c_name AS name, c_mktsegment AS query,
       NULL AS source_url, CAST(c_nationkey AS INTEGER) AS nationkey
FROM customer
UNION ALL
SELECT 's' || CAST(s_suppkey AS VARCHAR) AS placeId, s_name AS name, 'Direct URL' AS query,
       'supplier/' || CAST(s_suppkey AS VARCHAR) AS source_url, CAST(s_nationkey AS INTEGER) AS nationkey
FROM supplier
""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query-driven rows (customers) and URL-driven rows (suppliers, with
    ``source_url``) in one table by column name."""
    cust = load(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("placeId"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("query"), F.col("c_nationkey").cast("int").alias("nationkey"))
    supp = load(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("placeId"), F.col("s_name").alias("name"),
        F.lit(RQ.DIRECT_URL_LABEL).alias("query"),
        F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("source_url"),
        F.col("s_nationkey").cast("int").alias("nationkey"))
    return R.union_results(cust, supp).select("placeId", "name", "query", "source_url", "nationkey")


# ---------------------------------------------------------------------------
# Enrich joins: J2 J3 D13
# ---------------------------------------------------------------------------

@register("enrich_left", f"""
WITH d AS (
  SELECT o_custkey, o_orderpriority, o_orderstatus FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)
SELECT c.c_custkey AS placeId, c.c_name AS name,
       CASE WHEN d.o_orderpriority IS NOT NULL AND d.o_orderpriority <> ''
            THEN {S.standard_type('d.o_orderpriority')} ELSE c.c_mktsegment END AS businessType,
       CASE WHEN d.o_orderstatus IS NOT NULL AND d.o_orderstatus <> ''
            THEN {S.standard_price('d.o_orderstatus')} ELSE NULL END AS priceLevel
FROM customer c LEFT JOIN d ON d.o_custkey = c.c_custkey
""")
def enrich_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are listings, each customer's first order is its
    detail record; detail values replace listing values only when non-empty,
    passing through C2 (type) and C3 (price) — so a status letter becomes
    ``''`` while customers without orders keep NULL."""
    cust = load(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").select(
        F.col("c_custkey").alias("placeId"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("businessType"), F.lit(None).cast("string").alias("priceLevel"))
    orders = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority",
                  "o_orderstatus").select(
        F.col("o_custkey").alias("placeId"), F.struct("o_orderdate", "o_orderkey").alias("_order"),
        F.col("o_orderpriority").alias("businessType"), F.col("o_orderstatus").alias("priceLevel"))
    detail = R.one_per_key(orders, "placeId", "_order").drop("_order")
    merged = R.merge_details(cust, detail, fields=("businessType", "priceLevel"))
    return merged.select("placeId", "name", "businessType", "priceLevel")


# ---------------------------------------------------------------------------
# Run metrics: A1 A3–A8 over the events run log
# ---------------------------------------------------------------------------

_RUN_LOG_SQL = """
SELECT CAST(event_id AS VARCHAR) AS run_id, 'user ' || CAST(user_id AS VARCHAR) AS query,
       strftime(ts, '%Y-%m-%d') AS category, dayname(ts) AS scenario, ts AS started_at,
       CAST(round(value * 1000) AS BIGINT) AS duration_ms, event_type <> 'error' AS success,
       try_cast(nullif(regexp_extract(props, '"k":[ ]*(-?[0-9]+)', 1), '') AS BIGINT) AS result_count,
       CASE WHEN event_type = 'error' THEN
         CASE WHEN value >= 100 THEN 'Navigation timeout'
              WHEN try_cast(nullif(regexp_extract(props, '"k":[ ]*(-?[0-9]+)', 1), '') AS BIGINT) >= 50
              THEN 'Selector not found' ELSE 'Extraction failed' END END AS error
FROM events
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.run_log_from_events(load(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type",
                                      "value", "props"))


@register("run_summary", f"""
WITH log AS ({_RUN_LOG_SQL})
SELECT category, CAST(count(*) AS BIGINT) AS total_searches,
       CAST(coalesce(sum(CASE WHEN success THEN result_count END), 0) AS BIGINT) AS total_results,
       CAST(count(*) FILTER (WHERE NOT success) AS BIGINT) AS failed_searches,
       CAST(floor(coalesce(sum(CASE WHEN success THEN result_count END), 0) / count(*) + 0.5) AS BIGINT)
         AS avg_results_per_search,
       CAST(CAST(floor((count(*) - count(*) FILTER (WHERE NOT success)) / count(*) * 100 + 0.5) AS BIGINT)
         AS VARCHAR) || '%' AS success_rate,
       CAST(floor(date_diff('microsecond', min(started_at),
                  max(started_at + to_milliseconds(duration_ms))) / 1000000 + 0.5) AS BIGINT) AS duration_s
FROM log GROUP BY category
""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 per day: searches, results, failures, rounded average, success %."""
    return M.run_summary(_log(spark, sf_dir), by="category")


@register("rate_by_category", f"""
WITH log AS ({_RUN_LOG_SQL})
SELECT CASE WHEN GROUPING(category) = 1 THEN 'ALL' ELSE category END AS category,
       CAST(count(*) FILTER (WHERE success) AS BIGINT) AS passed,
       CAST(count(*) FILTER (WHERE NOT success) AS BIGINT) AS failed,
       CAST(count(*) AS BIGINT) AS total,
       floor(count(*) FILTER (WHERE success) * 10000.0 / count(*) + 0.5) / 100 AS pass_rate
FROM log GROUP BY ROLLUP (category)
""")
def rate_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: pass/fail totals and pass rate per day plus a total row (roll-up)."""
    return M.rate_by_category(_log(spark, sf_dir), "category")


@register("latency_stats", f"""
WITH log AS ({_RUN_LOG_SQL})
SELECT CASE WHEN GROUPING(scenario) = 1 THEN 'ALL' ELSE scenario END AS scenario,
       min(duration_ms) AS min_ms, max(duration_ms) AS max_ms,
       floor(sum(duration_ms) * 1000.0 / count(*) + 0.5) / 1000 AS avg_ms,
       CAST(count(*) FILTER (WHERE success) AS BIGINT) AS successes,
       CAST(count(*) FILTER (WHERE NOT success) AS BIGINT) AS failures
FROM log GROUP BY ROLLUP (scenario)
""")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: min/max/mean run time and success/failure counts per weekday and
    overall."""
    return M.latency_stats(_log(spark, sf_dir), "scenario")


_PCT_SQL = ", ".join(
    f"min(CASE WHEN rn = floor(n * {p}) + 1 THEN v END) AS {name}" for name, p in M.PERCENTILES)


@register("latency_percentiles", f"""
WITH log AS ({_RUN_LOG_SQL}),
t AS (SELECT scenario AS grp, duration_ms AS v FROM log UNION ALL SELECT 'ALL', duration_ms FROM log),
r AS (SELECT grp, v, row_number() OVER (PARTITION BY grp ORDER BY v) AS rn,
             count(*) OVER (PARTITION BY grp) AS n FROM t)
SELECT grp AS scenario, CAST(max(n) AS BIGINT) AS n, {_PCT_SQL}
FROM r GROUP BY grp
""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: p50/p90/p95/p99 at index floor(n·p) per weekday and overall."""
    return M.latency_percentiles(_log(spark, sf_dir), "scenario")


@register("latency_percentiles_approx")
def latency_percentiles_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, approximate variant (T8): ``percentile_approx`` per weekday and
    overall (checked against the exact job in tests, not by SQL)."""
    return M.latency_percentiles_approx(_log(spark, sf_dir), "scenario")


@register("throughput", f"""
WITH log AS ({_RUN_LOG_SQL}),
a AS (SELECT CASE WHEN GROUPING(scenario) = 1 THEN 'ALL' ELSE scenario END AS scenario,
             CAST(count(*) AS BIGINT) AS runs,
             date_diff('microsecond', min(started_at), max(started_at + to_milliseconds(duration_ms))) AS elapsed_us
      FROM log GROUP BY ROLLUP (scenario))
SELECT scenario, runs, CAST(floor(elapsed_us / 1000) AS BIGINT) AS elapsed_ms,
       CASE WHEN elapsed_us > 0 THEN runs / (elapsed_us / 1000000.0) END AS runs_per_s
FROM a
""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs per elapsed second per weekday and overall."""
    return M.throughput(_log(spark, sf_dir), "scenario")


@register("error_histogram", f"""
WITH log AS ({_RUN_LOG_SQL})
SELECT coalesce(error, '') AS error, CAST(count(*) AS BIGINT) AS n FROM log WHERE NOT success GROUP BY 1
""")
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed runs by error message."""
    return M.error_histogram(_log(spark, sf_dir))


@register("verdict", f"""
WITH log AS ({_RUN_LOG_SQL}),
st AS (SELECT CASE WHEN GROUPING(scenario) = 1 THEN 'ALL' ELSE scenario END AS scenario,
              count(*) FILTER (WHERE success) AS successes, count(*) FILTER (WHERE NOT success) AS failures,
              date_diff('microsecond', min(started_at), max(started_at + to_milliseconds(duration_ms))) AS elapsed_us,
              count(*) AS runs
       FROM log GROUP BY ROLLUP (scenario)),
t AS (SELECT scenario AS grp, duration_ms AS v FROM log UNION ALL SELECT 'ALL', duration_ms FROM log),
r AS (SELECT grp, v, row_number() OVER (PARTITION BY grp ORDER BY v) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM t),
p AS (SELECT grp, min(CASE WHEN rn = floor(n * 0.95) + 1 THEN v END) AS p95 FROM r GROUP BY grp)
SELECT st.scenario, successes / (successes + failures) AS success_rate,
       CASE WHEN successes / (successes + failures) >= {M.PASS_RATE} THEN 'pass'
            WHEN successes / (successes + failures) >= {M.PARTIAL_RATE} THEN 'partial' ELSE 'fail' END AS band,
       p.p95 > {M.P95_LIMIT_MS} AS slow_p95,
       failures / (successes + failures) > {M.FAILURE_LIMIT} AS high_failure,
       coalesce(CASE WHEN elapsed_us > 0 THEN runs / (elapsed_us / 1000000.0) END < {M.THROUGHPUT_FLOOR}, false)
         AS low_throughput
FROM st JOIN p ON p.grp = st.scenario
""")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success band and warning flags per weekday and overall."""
    return M.verdict(_log(spark, sf_dir), "scenario")


# ---------------------------------------------------------------------------
# Place ids from page links: L1–L4 (X3 + tag attributes)
# ---------------------------------------------------------------------------

def _page_anchor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages", "page_id", "url", "html")
    rows = pages.select("page_id", "url", F.posexplode(P.anchor_tags_expr("html")).alias("pos", "tag"))
    raw = L.tag_attr_expr("tag", "href")
    return rows.select(
        "page_id", "pos", P.resolve_url(P.decode_entities(raw), F.col("url")).alias("href"),
        *[P.decode_entities(L.tag_attr_expr("tag", a)).alias(a.replace("-", "_"))
          for a in ("data-pid", "data-place-id", "data-value")])


def _tag_attr_sql(t: str, name: str) -> str:
    ws = r"[ \t\n\f\r]"
    dq = rf"""(?is)[ \t\n\f\r"']{name}{ws}*={ws}*"([^"]*)\""""
    sq = rf"""(?is)[ \t\n\f\r"']{name}{ws}*={ws}*'([^']*)'"""
    bare = rf"""(?is)[ \t\n\f\r"']{name}{ws}*={ws}*([^ \t\n\f\r"'>]+)"""
    return (f"CASE WHEN {S.rlike(t, dq)} THEN {S.extract(t, dq, 1)} WHEN {S.rlike(t, sq)} THEN {S.extract(t, sq, 1)} "
            f"WHEN {S.rlike(t, bare)} THEN {S.extract(t, bare, 1)} END")


def _place_id_sql() -> str:
    attr = ("coalesce(nullif(data_pid, ''), nullif(data_place_id, ''), nullif(data_value, ''))")
    path_id = S.extract("href", L.PLACE_PATH, 1)
    hex_id = S.extract("href", L.HEX_ID, 1)
    pid = (f"coalesce(CASE WHEN starts_with({path_id}, 'ChI') THEN {path_id} END, "
           f"nullif({S.extract('href', L.DATA_CHI, 1)}, ''), nullif({S.extract('href', L.PID_19S, 1)}, ''), "
           f"CASE WHEN starts_with({attr}, 'ChI') THEN {attr} END, "
           f"CASE WHEN {hex_id} <> '' THEN 'hex_' || {hex_id} END, "
           f"'fallback_' || CAST(page_id AS VARCHAR) || '_' || CAST(pos AS VARCHAR))")
    return f"split_part({pid}, '?', 1)"


def _coord_sql(i: int) -> str:
    lit = S.float_literal(S.extract("href", L.COORDS, i))
    return f"CASE WHEN {S.rlike('href', L.COORDS)} THEN try_cast(nullif({lit}, '') AS DOUBLE) END"


_ANCHORS_SQL = f"""
SELECT page_id, pos, {S.resolve_url(S.decode_entities(_tag_attr_sql('tag', 'href')), 'url')} AS href,
       {S.decode_entities(_tag_attr_sql('tag', 'data-pid'))} AS data_pid,
       {S.decode_entities(_tag_attr_sql('tag', 'data-place-id'))} AS data_place_id,
       {S.decode_entities(_tag_attr_sql('tag', 'data-value'))} AS data_value
FROM (SELECT page_id, url, unnest(tg) AS tag, CAST(generate_subscripts(tg, 1) - 1 AS INTEGER) AS pos
      FROM (SELECT page_id, url, {S.anchor_tags('html')} AS tg FROM pages))
"""


@register("place_ids", f"""
SELECT page_id, pos, href, {_place_id_sql()} AS placeId, {_coord_sql(1)} AS latitude, {_coord_sql(2)} AS longitude
FROM ({_ANCHORS_SQL})
""")
def place_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1–L4 on every link of every page: place id by the priority chain
    (path, data parameters, link attributes, hex id, deterministic fallback)
    and coordinates.  No parent/first-div context exists without X1, so L2
    never fires here (covered by the listing job and unit tests)."""
    links = _page_anchor_rows(spark, sf_dir)
    out = L.with_coordinates(L.with_place_id(links))
    return out.select("page_id", "pos", "href", "placeId", "latitude", "longitude")


# ---------------------------------------------------------------------------
# Quality: V1–V7
# ---------------------------------------------------------------------------

def _quality_inputs(spark: SparkSession, sf_dir: str):
    links = L.with_place_id(_page_anchor_rows(spark, sf_dir))
    docs = load(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", first_phone_expr("text").alias("phone"), T.standard_address("text").alias("address"))
    log = _log(spark, sf_dir)
    return links, docs, log


V4_MIN_LINKS, V4_MAX_LINKS = 1, 50
V7_MAX_MS = 300_000


@register("quality_report", f"""
WITH links AS (SELECT page_id, pos, {_place_id_sql()} AS placeId FROM ({_ANCHORS_SQL})),
docs AS (SELECT doc_id, {S.standard_address('text')} AS address FROM documents),
log AS ({_RUN_LOG_SQL}),
per_page AS (SELECT page_id, count(*) AS n FROM links GROUP BY page_id)
SELECT 'V1 place_id' AS check_name, CAST(count(*) AS BIGINT) AS n_checked,
       CAST(count(*) FILTER (WHERE NOT (placeId IS NOT NULL AND strpos(placeId, '?') = 0 AND
            (starts_with(placeId, 'ChI') OR starts_with(placeId, 'hex_') OR starts_with(placeId, 'generated_')
             OR starts_with(placeId, 'fallback_')))) AS BIGINT) AS n_failed FROM links
UNION ALL
SELECT 'V2 address', CAST(count(*) AS BIGINT),
       CAST(count(*) FILTER (WHERE address IS NOT NULL AND address <> '' AND {S.rlike('address', V.RATING_SHAPE_JAVA)})
            AS BIGINT) FROM docs
UNION ALL
SELECT 'V4 links per page', CAST(count(*) AS BIGINT),
       CAST(count(*) FILTER (WHERE n < {V4_MIN_LINKS} OR n > {V4_MAX_LINKS}) AS BIGINT) FROM per_page
UNION ALL
SELECT 'V7 run time', CAST(count(*) AS BIGINT), CAST(count(*) FILTER (WHERE duration_ms > {V7_MAX_MS}) AS BIGINT)
FROM log
""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V2, V4, V7 as (check, checked, failed): place ids of all page links,
    standardised addresses of all documents, links-per-page bounds, run-time
    bound on the run log."""
    links, docs, log = _quality_inputs(spark, sf_dir)
    # V1 and V4 from one pass over the links: per-page counts, folded into
    # one row, then unpivoted (no second extraction of the same links).
    per_page = links.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"),
                                            F.count_if(~V.place_id_ok("placeId")).alias("bad"))
    folded = per_page.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("links"),
        F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad_ids"),
        F.count(F.lit(1)).alias("pages"),
        F.count_if((F.col("n") < V4_MIN_LINKS) | (F.col("n") > V4_MAX_LINKS)).alias("bad_pages"))
    v14 = folded.select(F.explode(F.array(
        F.struct(F.lit("V1 place_id").alias("check_name"), F.col("links").alias("n_checked"),
                 F.col("bad_ids").alias("n_failed")),
        F.struct(F.lit("V4 links per page").alias("check_name"), F.col("pages").alias("n_checked"),
                 F.col("bad_pages").alias("n_failed")))).alias("c")).select("c.*")
    v2 = docs.agg(F.lit("V2 address").alias("check_name"), F.count(F.lit(1)).alias("n_checked"),
                  F.count_if(~V.address_ok("address")).alias("n_failed"))
    v7 = log.agg(F.lit("V7 run time").alias("check_name"), F.count(F.lit(1)).alias("n_checked"),
                 F.count_if(F.col("duration_ms") > V7_MAX_MS).alias("n_failed"))
    return v14.unionByName(v2).unionByName(v7)


def _first_phone_sql(x: str) -> str:
    from placeweave.operators.phones import PHONE_PATTERNS

    whens = []
    for pattern in PHONE_PATTERNS:
        hit = S.extract(x, pattern, 1)
        whens.append(f"WHEN {hit} <> '' AND NOT {S.rlike(S.js_trim(hit), T.PRICE_RANGE)} THEN {S.js_trim(hit)}")
    return "CASE " + " ".join(whens) + " END"


_PLACE_OK_SQL = ("(placeId IS NOT NULL AND strpos(placeId, '?') = 0 AND (starts_with(placeId, 'ChI') OR "
                 "starts_with(placeId, 'hex_') OR starts_with(placeId, 'generated_') OR "
                 "starts_with(placeId, 'fallback_')))")


@register("violations", f"""
WITH links AS (SELECT page_id, pos, {_place_id_sql()} AS placeId FROM ({_ANCHORS_SQL})),
docs AS (SELECT doc_id, {_first_phone_sql('text')} AS phone, {S.standard_address('text')} AS address
         FROM documents),
log AS ({_RUN_LOG_SQL})
SELECT 'pages' AS source, CAST(page_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR) AS row_id,
       'placeId' AS field, placeId AS value
FROM links WHERE NOT {_PLACE_OK_SQL}
UNION ALL
SELECT 'documents', CAST(doc_id AS VARCHAR), 'address', address FROM docs
WHERE address IS NOT NULL AND address <> '' AND {S.rlike('address', V.RATING_SHAPE_JAVA)}
UNION ALL
SELECT 'documents', CAST(doc_id AS VARCHAR), 'phone', phone FROM docs
WHERE phone IS NOT NULL AND phone <> '' AND {S.rlike('phone', T.PRICE_RANGE)}
UNION ALL
SELECT 'runs', run_id, 'duration_ms', CAST(duration_ms AS VARCHAR) FROM log WHERE duration_ms > {V7_MAX_MS}
""")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: every failed V1 (page-link place ids), V2 (document addresses), V3
    (document phones) and V7 (run time) check as (source, row, field, value)."""
    links, docs, log = _quality_inputs(spark, sf_dir)
    v1 = V.violations(links.withColumn("row_id", F.concat_ws(":", F.col("page_id").cast("string"),
                                                             F.col("pos").cast("string"))),
                      "row_id", {"placeId": "place_id"}).withColumn("source", F.lit("pages"))
    v23 = V.violations(docs.withColumn("row_id", F.col("doc_id").cast("string")), "row_id",
                       {"address": "address", "phone": "phone"}).withColumn("source", F.lit("documents"))
    v7 = V.check_duration(log, V7_MAX_MS).select(
        F.lit("runs").alias("source"), F.col("run_id").alias("row_id"), F.lit("duration_ms").alias("field"),
        F.col("duration_ms").cast("string").alias("value"))
    return v1.unionByName(v23).unionByName(v7).select("source", "row_id", "field", "value")


# ---------------------------------------------------------------------------
# Hours: D4 and R5 on weekly hours derived from events
# ---------------------------------------------------------------------------

def _weekly_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, one entry per weekday with activity: the morning and the
    afternoon hour range glued as a captured page shows them
    (``08:00–11:0013:00–17:00``)."""
    ev = load(spark, sf_dir, "events", "ts", "user_id")
    hour = F.hour("ts")
    per_day = ev.groupBy("user_id", F.weekday("ts").alias("dow"), F.date_format("ts", "EEEE").alias("day")).agg(
        F.min(F.when(hour < 12, hour)).alias("am_lo"), F.max(F.when(hour < 12, hour)).alias("am_hi"),
        F.min(F.when(hour >= 12, hour)).alias("pm_lo"), F.max(F.when(hour >= 12, hour)).alias("pm_hi"))

    def rng(lo, hi):
        return F.when(F.col(lo).isNotNull(), F.concat(F.lpad(F.col(lo).cast("string"), 2, "0"), F.lit(":00–"),
                                                      F.lpad((F.col(hi) + 1).cast("string"), 2, "0"), F.lit(":00")))
    per_day = per_day.withColumn("hours", F.concat(F.coalesce(rng("am_lo", "am_hi"), F.lit("")),
                                                   F.coalesce(rng("pm_lo", "pm_hi"), F.lit(""))))
    # At most seven entries per user: a bounded collect.
    return per_day.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("dow", "day", "hours"))).alias("e")) \
        .select("user_id", F.transform("e", lambda x: F.struct(x["day"].alias("day"), x["hours"].alias("hours")))
                .alias("entries"))


_WEEKLY_SQL = """
WITH pd AS (
  SELECT user_id, isodow(ts) - 1 AS dow, dayname(ts) AS day,
         min(CASE WHEN hour(ts) < 12 THEN hour(ts) END) AS am_lo, max(CASE WHEN hour(ts) < 12 THEN hour(ts) END) AS am_hi,
         min(CASE WHEN hour(ts) >= 12 THEN hour(ts) END) AS pm_lo, max(CASE WHEN hour(ts) >= 12 THEN hour(ts) END) AS pm_hi
  FROM events GROUP BY user_id, isodow(ts) - 1, dayname(ts)),
pdh AS (
  SELECT user_id, dow, day,
         coalesce(CASE WHEN am_lo IS NOT NULL THEN lpad(CAST(am_lo AS VARCHAR), 2, '0') || ':00–' ||
                       lpad(CAST(am_hi + 1 AS VARCHAR), 2, '0') || ':00' END, '') ||
         coalesce(CASE WHEN pm_lo IS NOT NULL THEN lpad(CAST(pm_lo AS VARCHAR), 2, '0') || ':00–' ||
                       lpad(CAST(pm_hi + 1 AS VARCHAR), 2, '0') || ':00' END, '') AS hours
  FROM pd)
"""


def _split_glued_sql(x: str) -> str:
    return S.rx_all(S.rx_all(x, H.TWO_RANGES, "$1 $2"), H.TWO_TIMES, "$1 $2")


@register("hours_list", _WEEKLY_SQL + f"""
SELECT user_id, string_agg(day || ': ' || {_split_glued_sql('hours')}, ' | ' ORDER BY dow) AS hours,
       CAST(count(*) AS BIGINT) AS n_days
FROM pdh WHERE hours <> '' GROUP BY user_id
""")
def hours_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4 over weekly hours derived from each user's activity: ``Day: hours``
    in Monday..Sunday order with glued ranges separated."""
    entries = _weekly_entries(spark, sf_dir)
    lst = H.hours_list("entries")
    return entries.select("user_id", F.array_join(lst, " | ").alias("hours"),
                          F.size(lst).cast("long").alias("n_days"))


@register("hours_patterns", _WEEKLY_SQL + """
SELECT day, hours, CAST(count(*) AS BIGINT) AS n FROM pdh GROUP BY day, hours
""")
def hours_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explode each user's day→hours map and count (day, hours) patterns."""
    entries = _weekly_entries(spark, sf_dir)
    return AN.hours_patterns(entries.select(H.hours_map("entries").alias("hoursDetail")))


# ---------------------------------------------------------------------------
# Analyses: R1 R2 R3 R4 R6
# ---------------------------------------------------------------------------

@register("density", """
SELECT CASE WHEN GROUPING(n.n_name) = 1 THEN 'ALL' ELSE n.n_name END AS n_name,
       CASE WHEN GROUPING(c.c_mktsegment) = 1 THEN 'ALL' ELSE c.c_mktsegment END AS c_mktsegment,
       CAST(count(*) AS BIGINT) AS n
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
GROUP BY CUBE (n.n_name, c.c_mktsegment)
""")
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer density by nation and segment (cube)."""
    cust = load(spark, sf_dir, "customer", "c_nationkey", "c_mktsegment")
    nation = load(spark, sf_dir, "nation", "n_nationkey", "n_name")
    joined = cust.join(nation, cust["c_nationkey"] == nation["n_nationkey"])
    return AN.density(joined, ["n_name", "c_mktsegment"])


@register("rating_rank", """
WITH ranked AS (
  SELECT p_type, p_partkey, p_retailprice,
         rank() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rnk
  FROM part),
st AS (
  SELECT p_type, count(*) AS group_n, floor(sum(round(p_retailprice * 100)) * 1.0 / count(*) + 0.5) / 100 AS group_avg,
         min(p_retailprice) AS group_min, max(p_retailprice) AS group_max
  FROM part GROUP BY p_type)
SELECT r.p_type, r.p_partkey, CAST(r.rnk AS INTEGER) AS rank, r.p_retailprice,
       CAST(st.group_n AS BIGINT) AS group_n, st.group_avg, st.group_min, st.group_max
FROM ranked r JOIN st ON st.p_type = r.p_type
""")
def rating_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: every part's rank by price inside its type, with the type's count,
    mean (to the cent), min and max — the ranking report of the README."""
    part = load(spark, sf_dir, "part", "p_partkey", "p_type", "p_retailprice")
    out = AN.rating_rank(part, "p_type", "p_retailprice", tiebreak="p_partkey")
    return out.select("p_type", "p_partkey", F.col("rank").cast("int"), "p_retailprice",
                      "group_n", "group_avg", "group_min", "group_max")


@register("rating_distribution", """
WITH b AS (
  SELECT p_type, floor(p_retailprice / 100.0) * 100.0 AS band, count(*) AS n FROM part GROUP BY ALL
)
SELECT p_type, band, n, n / sum(n) OVER (PARTITION BY p_type) AS share,
       sum(n) OVER (PARTITION BY p_type ORDER BY band) / sum(n) OVER (PARTITION BY p_type) AS share_upto
FROM b
""")
def rating_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: the distribution of prices inside each type, by bands of 100."""
    return AN.rating_distribution(load(spark, sf_dir, "part", "p_type", "p_retailprice"), "p_type", "p_retailprice", 100.0)


@register("no_website", """
WITH b AS (
  SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 <> 0 THEN 'https://site' || CAST(c_custkey % 400 AS VARCHAR) || '.example' END AS website
  FROM customer)
SELECT c_custkey, c_name, website FROM b
WHERE website IS NULL
   OR website NOT IN (SELECT 'https://site' || CAST(o_orderkey % 397 AS VARCHAR) || '.example' FROM orders WHERE o_orderstatus = 'F')
""")
def no_website(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunities — businesses (customers) without a website, and those
    whose site was never captured.  Four in five customers have a site; the
    captured sites are those that finished orders point to."""
    site = F.concat(F.lit("https://site"), (F.col("c_custkey") % 400).cast("string"), F.lit(".example"))
    business = load(spark, sf_dir, "customer", "c_custkey", "c_name").withColumn(
        "website", F.when(F.col("c_custkey") % 5 != 0, site))
    captured = load(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'F'").select(
        F.concat(F.lit("https://site"), (F.col("o_orderkey") % 397).cast("string"), F.lit(".example")).alias("url"))
    return AN.no_website(business, captured).select("c_custkey", "c_name", "website")


@register("contacts", f"""
SELECT source, email, CAST(count(*) AS BIGINT) AS n_businesses
FROM (SELECT source, unnest({S.extract_emails('text')}) AS email FROM documents)
GROUP BY source, email
""")
def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact list — distinct e-mails per document source with counts."""
    docs = load(spark, sf_dir, "documents", "source", "text")
    return AN.contacts(docs.select("source", T.extract_emails("text").alias("emails")), "source")


LATEST_SNAPSHOT_SQL = """
WITH two AS (
  SELECT user_id, event_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events)
SELECT user_id, max(CASE WHEN rn = 1 THEN event_id END) AS latest_event_id,
       max(CASE WHEN rn = 1 THEN value END) AS latest_value,
       max(CASE WHEN rn = 2 THEN value END) AS previous_value,
       CASE WHEN count(*) FILTER (WHERE rn <= 2) < 2 THEN NULL
            ELSE max(CASE WHEN rn = 1 THEN value END) IS DISTINCT FROM max(CASE WHEN rn = 2 THEN value END) END
         AS changed
FROM two WHERE rn <= 2 GROUP BY user_id
"""


@register("latest_snapshot", LATEST_SNAPSHOT_SQL)
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest capture per user and whether its value changed since the
    capture before."""
    ev = load(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    snap = AN.latest_snapshot(ev, "user_id", "ts", "event_id", "value")
    return snap.select("user_id", "latest_event_id", "latest_value", "previous_value", "changed")
