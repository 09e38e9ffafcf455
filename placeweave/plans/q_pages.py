"""Registered queries over ``pages`` and ``documents``/``conversations``:
X2, X3, E1–E8, C1–C14, L11 (flagship: ``page_emails``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions import text as T
from placeweave.functions.arrays import size_or_null
from placeweave.operators import emails as E
from placeweave.operators import pages as P
from placeweave.operators.phones import first_phone_expr
from placeweave.plans import sqlgen as S
from placeweave.plans.registry import register
from placeweave.sources.tables import dealt, load


# ---------------------------------------------------------------------------
# Pages: X2, X3, E2–E6 (flagship: page_emails)
# ---------------------------------------------------------------------------

_PAGE_EMAILS_SQL = f"""
WITH p AS (
  SELECT page_id, url, html,
         {S.anchor_hrefs('html')} AS hrefs,
         {S.ordered_distinct(f"list_concat({S.text_emails(S.visible_text('html'))}, {S.mailto_emails('html')})")} AS emails
  FROM pages)
SELECT page_id,
       {S.extract('url', P.URL_ORIGIN, 1)} AS host,
       CAST(len(hrefs) AS BIGINT) AS n_links,
       CAST(len(emails) AS BIGINT) AS n_emails,
       emails[1] AS email,
       array_to_string(emails, ',') AS emails,
       CAST(len(list_filter(emails, lambda e: NOT {S.blacklisted('e')}
            AND {S.rlike('e', T.EMAIL_SHAPE_STRICT)})) AS BIGINT) AS n_kept
FROM p
"""


@register("page_emails", _PAGE_EMAILS_SQL)
def page_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: per page, the ordered distinct e-mails of visible text and
    ``mailto:`` links (unfiltered — every driver e-mail is on a blacklisted
    domain), the first one, link count, host, and how many survive E5."""
    pages = load(spark, sf_dir, "pages", "page_id", "url", "html")
    emails = E.page_emails_expr("html")
    return (pages.select(
        "page_id", "url",
        F.when(F.col("html").isNotNull(), F.size(P.anchor_hrefs_expr("html"))).cast("long").alias("n_links"),
        emails.alias("emails"))
        .select(
            "page_id",
            F.regexp_extract("url", P.URL_ORIGIN, 1).alias("host"),
            "n_links",
            size_or_null(F.col("emails")).cast("long").alias("n_emails"),
            F.try_element_at("emails", F.lit(1)).alias("email"),
            F.array_join("emails", ",").alias("emails"),
            size_or_null(E.filter_emails_expr("emails")).cast("long").alias("n_kept")))


@register("page_links", f"""
SELECT page_id, pos, href, {S.resolve_url('href', 'url')} AS link_url FROM (
  SELECT page_id, url, unnest(h) AS href, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS pos
  FROM (SELECT page_id, url, {S.anchor_hrefs('html')} AS h FROM pages))
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``<a href>`` of every page, in document order, resolved."""
    return P.page_links(load(spark, sf_dir, "pages", "page_id", "url", "html"))


@register("page_visible_text", f"""
SELECT page_id, t AS text, CAST(length(t) AS BIGINT) AS n_chars
FROM (SELECT page_id, {S.visible_text('html')} AS t FROM pages)
""")
def page_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of each page."""
    pages = load(spark, sf_dir, "pages", "page_id", "html")
    return (pages.select("page_id", P.visible_text_expr("html").alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))


# ---------------------------------------------------------------------------
# Documents: C11, E5/J4/E8, L11
# ---------------------------------------------------------------------------

@register("document_emails", f"""
SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS email
FROM (SELECT doc_id, {S.extract_emails('text')} AS l FROM documents)
""")
def document_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11 over whole document texts: one row per (document, distinct e-mail)."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.posexplode(T.extract_emails("text")).alias("pos", "email"))


def _rule_sql(e: str) -> str:
    whens = " ".join(f"WHEN strpos(lower({e}), {S.q(w)}) > 0 THEN {S.q('blacklist:' + w)}"
                     for w in E.EMAIL_BLACKLIST)
    return f"CASE {whens} WHEN NOT {S.rlike(e, T.EMAIL_SHAPE_STRICT)} THEN 'bad_shape' ELSE 'kept' END"


@register("email_filter_report", f"""
WITH found AS (
  SELECT 'documents' AS source, unnest({S.extract_emails('text')}) AS email FROM documents
  UNION ALL
  SELECT 'pages' AS source,
         unnest({S.ordered_distinct(f"list_concat({S.text_emails(S.visible_text('html'))}, {S.mailto_emails('html')})")}) AS email
  FROM pages)
SELECT source, rule, CAST(count(*) AS BIGINT) AS n_emails, CAST(count(DISTINCT email) AS BIGINT) AS n_distinct
FROM (SELECT source, email, {_rule_sql('email')} AS rule FROM found)
GROUP BY source, rule
""")
def email_filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mails found in documents and pages, counted by the first
    E5 rule that drops them (or ``kept``)."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text").select(
        F.lit("documents").alias("source"), F.explode(T.extract_emails("text")).alias("email"))
    pages = load(spark, sf_dir, "pages", "page_id", "html").select(
        F.lit("pages").alias("source"), F.explode(E.page_emails_expr("html")).alias("email"))
    found = docs.unionByName(pages)
    rule = F.when(F.lit(False), F.lit(None))
    for word in E.EMAIL_BLACKLIST:
        rule = rule.when(F.lower("email").contains(word), F.lit("blacklist:" + word))
    rule = rule.when(~F.col("email").rlike(T.EMAIL_SHAPE_STRICT), F.lit("bad_shape")).otherwise(F.lit("kept"))
    return (found.withColumn("rule", rule).groupBy("source", "rule")
            .agg(F.count(F.lit(1)).alias("n_emails"), F.countDistinct("email").alias("n_distinct")))


def _first_phone_sql(x: str) -> str:
    from placeweave.operators.phones import PHONE_PATTERNS

    whens = []
    for pattern in PHONE_PATTERNS:
        hit = S.extract(x, pattern, 1)
        whens.append(f"WHEN {hit} <> '' AND NOT {S.rlike(S.js_trim(hit), T.PRICE_RANGE)} THEN {S.js_trim(hit)}")
    return "CASE " + " ".join(whens) + " END"


@register("document_phones", f"""
SELECT doc_id, phone, {S.standard_phone('phone')} AS std_phone
FROM (SELECT doc_id, {_first_phone_sql('text')} AS phone FROM documents)
WHERE phone IS NOT NULL
""")
def document_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L11 over whole document texts, then C7 on the hit."""
    from placeweave.operators.relational import where_computed

    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    found = where_computed(docs, ["doc_id"], {"phone": first_phone_expr("text")}, lambda s: s["phone"].isNotNull())
    return found.withColumn("std_phone", T.standard_phone("phone"))


# ---------------------------------------------------------------------------
# Text standardisation over documents and conversations: C1 C6 C8, C2–C14
# ---------------------------------------------------------------------------

@register("clean_text", f"""
SELECT 'documents' AS source, doc_id AS id, CAST(0 AS BIGINT) AS turn,
       {S.clean_unicode('text')} AS clean, {S.standard_name('text')} AS name,
       {S.compact_address('text')} AS compact
FROM documents
UNION ALL
SELECT 'conversations' AS source, conv_id AS id, turn,
       {S.clean_unicode('text')} AS clean, {S.standard_name('text')} AS name,
       {S.compact_address('text')} AS compact
FROM conversations
""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1, C6, C8 over every document and conversation turn (whole texts)."""
    def rules(df, source, id_col, turn):
        return df.select(F.lit(source).alias("source"), F.col(id_col).alias("id"), turn.alias("turn"),
                         T.clean_unicode("text").alias("clean"), T.standard_name("text").alias("name"),
                         T.compact_address("text").alias("compact"))
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    conv = load(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return rules(docs, "documents", "doc_id", F.lit(0).cast("long")).unionByName(
        rules(conv, "conversations", "conv_id", F.col("turn")))


@register("standardise_documents", f"""
SELECT doc_id,
       {S.standard_type('text')} AS std_type,
       {S.standard_price('text')} AS std_price,
       {S.standard_hours('text')} AS std_hours,
       {S.standard_address('text')} AS std_address,
       {S.standard_phone('text')} AS std_phone,
       {S.is_email('text')} AS is_email,
       {S.standard_rating('text')} AS std_rating,
       {S.standard_rating('CAST(n_chars AS DOUBLE) / 1000')} AS size_rating,
       {S.standard_reviews('text')} AS std_reviews,
       {S.standard_reviews('n_chars')} AS size_reviews,
       {S.strict_type('text')} AS strict_type
FROM documents
""")
def standardise_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2–C5, C7, C10, C12–C14 applied to whole document texts and sizes."""
    docs = dealt(load(spark, sf_dir, "documents", "doc_id", "text", "n_chars", spread_rows=False))
    docs = docs.withColumn("cleaned", T.clean_unicode("text"))       # once for C2, C4 and C5
    return docs.select(
        "doc_id",
        T.standard_type("text", "cleaned").alias("std_type"),
        T.standard_price("text").alias("std_price"),
        T.standard_hours("text", "cleaned").alias("std_hours"),
        T.standard_address("text", "cleaned").alias("std_address"),
        T.standard_phone("text").alias("std_phone"),
        T.is_email("text").alias("is_email"),
        T.standard_rating("text").alias("std_rating"),
        T.standard_rating(F.col("n_chars").cast("double") / 1000).alias("size_rating"),
        T.standard_reviews("text").alias("std_reviews"),
        T.standard_reviews("n_chars").alias("size_reviews"),
        T.strict_type("text").alias("strict_type"))


# ---------------------------------------------------------------------------
# Websites: C9, E1 and a host roll-up
# ---------------------------------------------------------------------------

@register("website_standard", f"""
SELECT host, CAST(count(*) AS BIGINT) AS n_pages, CAST(sum(CASE WHEN eligible THEN 1 ELSE 0 END) AS BIGINT) AS n_eligible,
       min(website) AS first_site, max(website) AS last_site
FROM (SELECT {S.extract('url', P.URL_ORIGIN, 1)} AS host, {S.standard_website('url')} AS website,
             (url IS NOT NULL AND url <> '' AND strpos(url, 'google.com') = 0) AS eligible
      FROM pages)
GROUP BY host
""")
def website_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9 on every page URL and E1 eligibility, rolled up by host."""
    pages = load(spark, sf_dir, "pages", "url")
    eligible = F.col("url").isNotNull() & (F.col("url") != "") & ~F.col("url").contains("google.com")
    return (pages.select(F.regexp_extract("url", P.URL_ORIGIN, 1).alias("host"),
                         T.standard_website("url").alias("website"), eligible.alias("eligible"))
            .groupBy("host")
            .agg(F.count(F.lit(1)).alias("n_pages"),
                 F.sum(F.col("eligible").cast("long")).alias("n_eligible"),
                 F.min("website").alias("first_site"), F.max("website").alias("last_site")))
