"""Website e-mail enrichment.

Page e-mails are computed per page with narrow expressions (no shuffle); the
only shuffle is the final left join of the small ``(url, emails)`` projection
onto the business table, on the website URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions.text import EMAIL_IN_TEXT, EMAIL_SHAPE_STRICT
from placeweave.operators.pages import anchor_hrefs_expr, visible_text_expr
from placeweave.operators.relational import newest_first
from placeweave.operators.visibility import shown_texts

# Substrings that disqualify an e-mail address (E5).
EMAIL_BLACKLIST = ("example.com", "sentry.io", "wixpress.com", "noreply", "no-reply")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def eligible_websites(df: DataFrame, website: str = "website") -> DataFrame:
    """Rows with a non-empty website that is not on google.com."""
    w = F.col(website)
    return df.filter(w.isNotNull() & (w != "") & ~w.contains("google.com"))


def text_emails_expr(text) -> Column:
    """E-mails in visible text, lower-cased, in order of appearance."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(EMAIL_IN_TEXT), 0), lambda e: F.lower(e))


def mailto_emails_expr(html) -> Column:
    """``mailto:`` links — prefix removed, cut at ``?``, lower-cased, non-empty."""
    hrefs = F.filter(anchor_hrefs_expr(html), lambda h: h.startswith("mailto:"))
    emails = F.transform(hrefs, lambda h: F.lower(F.substring_index(F.substr(h, F.lit(8)), "?", 1)))
    return F.filter(emails, lambda e: e != "")


def page_emails_expr(html) -> Column:
    """Ordered distinct union, text hits before mailto hits."""
    return F.array_distinct(F.concat(text_emails_expr(visible_text_expr(html)), mailto_emails_expr(html)))


def blacklisted(email: Column) -> Column:
    low = F.lower(email)
    hit = F.lit(False)
    for word in EMAIL_BLACKLIST:
        hit = hit | low.contains(word)
    return hit


def filter_emails_expr(emails) -> Column:
    """E5: drop blacklisted addresses; keep only the strict full-match shape."""
    return F.filter(_c(emails), lambda e: ~blacklisted(e) & e.rlike(EMAIL_SHAPE_STRICT))


def page_emails(pages: DataFrame, apply_filter: bool = True, keep: list[str] | None = None) -> DataFrame:
    """E2–E6 per captured website page: ``(url, emails, email)``.

    ``apply_filter=False`` skips E5 (all driver e-mails sit on a blacklisted
    domain, so reports run unfiltered)."""
    raw = page_emails_expr("html")
    emails = filter_emails_expr(raw) if apply_filter else raw
    return (pages.select("page_id", "url", *(keep or []), emails.alias("emails"))
            .withColumn("email", F.try_element_at("emails", F.lit(1))))


def site_key(url) -> Column:
    """The same key for every spelling of a site's address: scheme and host
    lower-cased, default port, fragment and a lone final slash dropped."""
    c = F.substring_index(_c(url), "#", 1)
    origin = F.lower(F.regexp_extract(c, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?]*)", 1))
    path = F.substr(c, F.length(origin) + 1)
    origin = F.regexp_replace(F.regexp_replace(origin, r"^(http://[^@]*):80\z", "$1"), r"^(https://[^@]*):443\z", "$1")
    return F.when(path == "/", origin).otherwise(F.concat(origin, path))


def shown_page_emails(pages: DataFrame, apply_filter: bool = True, keep: list[str] | None = None) -> DataFrame:
    """E2–E6 like :func:`page_emails`, with E2 over the text that the page shows
    (``visibility``): an address in a hidden element is none.  ``mailto:``
    links count wherever they are, as in the DOM."""
    shown = shown_texts(pages.select("page_id", "url", *(keep or []), "html", F.col("html").alias("_page")), "_page", "_shown")
    raw = F.array_distinct(F.concat(text_emails_expr("_shown"), mailto_emails_expr("html")))
    emails = filter_emails_expr(raw) if apply_filter else raw
    return (shown.select("page_id", "url", *(keep or []), emails.alias("emails"))
            .withColumn("email", F.try_element_at("emails", F.lit(1))))


def enrich_emails(business: DataFrame, website_pages: DataFrame, apply_filter: bool = True, shown_only: bool = False) -> DataFrame:
    """Left-join page e-mails onto businesses by website (:func:`site_key`);
    ``shown_only`` leaves out hidden text (one Arrow pass over the pages).

    Eligible rows (E1) with no captured page get ``email = NULL, emails = []``
    (a failed fetch); rows that were never eligible keep NULL in both."""
    # One row per site (the newest capture, then the lowest page_id, wins); a
    # partial aggregate: one small row per site and map task is shuffled.
    order = newest_first("captured_at", "page_id") if "captured_at" in website_pages.columns else F.col("page_id")
    read = shown_page_emails if shown_only else page_emails
    found = (read(website_pages, apply_filter, keep=[c for c in ("captured_at",) if c in website_pages.columns])
             .groupBy(site_key("url").alias("_site"))
             .agg(F.min_by("emails", order).alias("_emails")))
    eligible = (F.col("website").isNotNull() & (F.col("website") != "")
                & ~F.col("website").contains("google.com"))
    joined = business.join(found, site_key(business["website"]) == found["_site"], "left")
    emails = F.when(eligible, F.coalesce(F.col("_emails"), F.array().cast("array<string>")))
    return (joined.withColumn("emails", emails)
            .withColumn("email", F.when(eligible, F.try_element_at(F.col("emails"), F.lit(1))))
            .drop("_site", "_emails"))
