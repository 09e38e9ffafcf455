"""Listing extraction: one row per place link of a captured listing page
(L1–L12, with the in-page first-wins dedupe W1).

Runs on the X1 element table.  Everything happens inside the page's row as
staged higher-order expressions — candidate lists per selector are filtered
once per page, each link then looks only at those short lists — so the job is
narrow (no shuffle) and a page's element array is never copied per link.
Stages are separate projections; each stage reads the previous stage's array
once, so Catalyst keeps them apart instead of re-inlining expensive parts.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions.text import WS, WS_BODY, float_prefix, int_prefix, js_length, js_trim, let
from placeweave.operators import elements as X
from placeweave.operators.pages import resolve_url
from placeweave.operators.phones import first_phone_expr
from placeweave.operators.placeids import coordinate_of, place_id_of
from placeweave.operators.relational import explode_rows

PLACE_LINK = "/maps/place/"

# Listing-card selectors of the captured result pages.
CONTAINER_JSACTION = "mouseover:pane"
NAME_CLASSES = ("fontHeadlineSmall", "fontBodyMedium")
RATING_LABELS = ("star", "Star", "星")
RATING_CLASS = "MW4etd"
DETAIL_BLOCK_CLASS = "W4Efsd"

# L8 — a span is not a business type when it matches any of
# these (ratings, review counts, prices, open/closed states, times, hotel
# booking prompts).
TYPE_REJECT = (
    r"^[0-9]+\.[0-9]+", rf"[0-9]+\.[0-9]+{WS}*\([0-9]+", r"\([0-9]+[0-9,]*\)", "·", r"\$[0-9]+", r"^\$+\z",
    r"¥[0-9]+", r"^[開營已關]", r"AM|PM|時間|Hours", "選取日期", "Select dates", "查看房價", "最佳房價", "View prices",
)
# L9 — address candidates are rejected by these …
ADDRESS_REJECT = (r"營業|已打烊|Opens|Closes|AM|PM|⋅|時間", r"\$[0-9]+", rf"^[0-9.]+{WS}*\([0-9,]+\)\z",
                  r"^\([0-9,]+\)\z", r"^[0-9]+-[0-9]+\z")
# … and need one of these: a number, a CJK address character, an English
# street word (a case-insensitive substring, so any "st" qualifies), a comma.
ADDRESS_NEED = (r"[0-9]+", "[區市縣鄉鎮村里路街巷弄號樓]",
                "(?i)Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Boulevard|Blvd|Lane|Ln|Way|Plaza|Place|Court|Ct", ",")
# L10 — the fallback over the first block's "·" parts.
FALLBACK_REJECT = (r"營業|已打烊|Opens|Closes|AM|PM|⋅", rf"^[0-9.]+{WS}*\([0-9,]+\)\z", r"^\([0-9,]+\)\z",
                   r"^[0-9]+-[0-9]+\z")
FALLBACK_NEED = (r"[0-9]+", "[區市縣路街]")

LISTING_SCHEMA = ("page_id BIGINT, pos INT, name STRING, placeId STRING, latitude DOUBLE, longitude DOUBLE, "
                  "rating DOUBLE, reviews BIGINT, address STRING, businessType STRING, phone STRING, url STRING")


def _alternation(patterns) -> str:
    """One regex matching where any of ``patterns`` matches (a leading
    ``(?i)`` becomes a scoped ``(?i:…)`` group)."""
    parts = []
    for p in patterns:
        parts.append(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})")
    return "|".join(parts)


def _none_of(c: Column, patterns) -> Column:
    return ~c.rlike(_alternation(patterns))


def _any_of(c: Column, patterns) -> Column:
    return c.rlike(_alternation(patterns))


def type_ok(t: Column) -> Column:
    """L8 span test (``t`` is a trimmed, non-empty span text)."""
    n = js_length(t)
    return _none_of(t, TYPE_REJECT) & (n > 1) & (n < 50)


def address_ok(t: Column) -> Column:
    """L9 candidate test."""
    return (t != "") & _none_of(t, ADDRESS_REJECT) & _any_of(t, ADDRESS_NEED)


def fallback_address_ok(t: Column) -> Column:
    """L10 part test."""
    return (t != "") & _none_of(t, FALLBACK_REJECT) & _any_of(t, FALLBACK_NEED)


def _div(e: Column) -> Column:
    return X.is_tag(e, "div")


def _span(e: Column) -> Column:
    return X.is_tag(e, "span")


def _rating_img(word: str):
    return lambda e: _span(e) & X.attr_equals(e, "role", "img") & X.attr_contains(e, "aria-label", word)


# Selector predicates, in the priority order of each chain.
CONTAINER_PREDS = (
    lambda e: _div(e) & X.attr_contains(e, "jsaction", CONTAINER_JSACTION),
    lambda e: _div(e) & X.has_attr(e, "data-cid"),
    lambda e: _div(e) & X.has_attr(e, "jsaction"),
)
NAME_PREDS = (
    lambda e: _div(e) & X.attr_contains(e, "class", NAME_CLASSES[0]),
    lambda e: _div(e) & X.attr_contains(e, "class", NAME_CLASSES[1]),
    lambda e: X.attr_equals(e, "role", "heading"),
)
RATING_PREDS = tuple(_rating_img(w) for w in RATING_LABELS) + (
    lambda e: _span(e) & X.attr_contains(e, "class", RATING_CLASS),)


def _block(e: Column) -> Column:
    return _div(e) & X.attr_contains(e, "class", DETAIL_BLOCK_CLASS)


def _with_pid(x: Column) -> Column:
    """Stage 2: the place id of one link (L1–L3)."""
    els = F.col("elements")
    l = x["el"]
    parent = X.parent_of(els, l)
    first_div = X.text_of(X.first_descendant_where(els, l, _div))
    pid = place_id_of(x["href"], X.attr(l, "data-pid"), X.attr(l, "data-place-id"), X.attr(l, "data-value"),
                      X.attr(parent, "data-pid"), X.attr(parent, "data-place-id"), first_div,
                      F.col("page_id"), x["pos"])
    return F.struct(x["pos"].alias("pos"), l.alias("el"), x["href"].alias("href"), pid.alias("placeId"))


def _container(x: Column) -> Column:
    """Stage 3: the card container — nearest matching ancestor (parent walk),
    else the third, else the second ancestor (X5)."""
    els = F.col("elements")
    l = x["el"]
    p2 = X.parent_of(els, X.parent_of(els, l))
    p3 = X.parent_of(els, p2)
    cont = F.coalesce(*[X.closest_where(els, l, pred) for pred in CONTAINER_PREDS], p3, p2)
    return F.struct(x["pos"].alias("pos"), l.alias("el"), x["href"].alias("href"), x["placeId"].alias("placeId"),
                    cont.alias("cont"))


def _block_texts(b: Column) -> Column:
    """Trimmed, non-empty texts of the spans inside block ``b``."""
    texts = F.transform(X.descendants_where("elements", b, _span), lambda s: js_trim(X.text_of(s)))
    return F.filter(texts, lambda t: t != "")


def _card(x: Column) -> Column:
    """Stage 4: what several fields read, computed once per link — the
    container's text, the span texts of each detail block, the first block's
    text (inside a lambda nothing is shared, so every reuse must be bound)."""
    els = F.col("elements")
    cont = x["cont"]
    blocks = X.descendants_where(els, cont, _block)
    return F.struct(
        x["pos"].alias("pos"), x["el"].alias("el"), x["href"].alias("href"), x["placeId"].alias("placeId"),
        cont.alias("cont"), X.text_of(cont).alias("cont_text"),
        F.transform(blocks, _block_texts).alias("texts"),
        F.coalesce(X.text_of(F.try_element_at(blocks, F.lit(1))), F.lit("")).alias("first_block_text"))


def _longest(cands: Column) -> Column:
    """First strictly-longest candidate (JavaScript lengths), each length
    computed once."""
    init = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"))

    def step(acc, t):
        return let(js_length(t), lambda n: F.when(n > acc["n"], F.struct(t.alias("t"), n.alias("n"))).otherwise(acc))
    return F.aggregate(cands, init, step, lambda acc: acc["t"])


def _fields(x: Column) -> Column:
    """Stage 5: every listing field from the link and its card.  All element
    lookups stay inside the card's subtree (a slice of the element array)."""
    els = F.col("elements")
    l, cont = x["el"], x["cont"]
    name_el = X.first_match(*[X.descendants_where(els, cont, p) for p in NAME_PREDS],
                            X.descendants_where(els, l, _div))
    name = F.coalesce(js_trim(X.text_of(name_el)), F.lit(""))

    rating_el = X.first_match(*[X.descendants_where(els, cont, p) for p in RATING_PREDS])
    rating_text = let(rating_el, lambda r: F.coalesce(F.nullif(X.attr(r, "aria-label"), F.lit("")),
                                                       F.nullif(X.text_of(r), F.lit("")), F.lit("")))
    number = F.coalesce(F.nullif(F.regexp_extract(rating_text, "[0-9.]+", 0), F.lit("")), F.lit("0"))
    rating = let(float_prefix(number), lambda r: F.when(r != 0, r))   # 0 and NaN (NULL here) → NULL

    reviews_raw = F.regexp_extract(x["cont_text"], r"\(([0-9]+[,0-9]*)\)", 1)
    reviews = F.coalesce(int_prefix(F.replace(reviews_raw, F.lit(","), F.lit(""))), F.lit(0).cast("long"))

    texts = x["texts"]
    per_block_type = F.transform(texts, lambda ts: F.try_element_at(F.filter(ts, type_ok), F.lit(1)))
    btype = F.try_element_at(F.filter(per_block_type, lambda t: t.isNotNull()), F.lit(-1))
    cands = F.transform(F.flatten(F.transform(texts, lambda ts: F.reverse(ts))),
                        lambda t: js_trim(F.regexp_replace(t, f"^[·{WS_BODY}]+", "")))
    address = _longest(F.filter(cands, address_ok))

    parts = F.transform(F.split(x["first_block_text"], "·"), lambda p: js_trim(p))
    fb_address = F.try_element_at(F.filter(F.reverse(parts), fallback_address_ok), F.lit(1))
    part0 = F.try_element_at(parts, F.lit(1))

    return F.struct(
        x["pos"].alias("pos"), name.alias("name"), x["placeId"].alias("placeId"),
        coordinate_of(x["href"], 1).alias("latitude"), coordinate_of(x["href"], 2).alias("longitude"),
        rating.alias("rating"), reviews.alias("reviews"),
        address.alias("_address"), fb_address.alias("_fb_address"), btype.alias("_type"), part0.alias("_part0"),
        first_phone_expr(x["cont_text"]).alias("phone"), x["href"].alias("url"))


def first_wins(links: Column) -> Column:
    """W1 inside a page: the first link (page order) of each place id, in
    O(n log n) — sort (id, pos) pairs, keep the first of each id, sort the
    kept positions back and fetch those links by index (``pos`` is the
    link's index in ``links``)."""
    pairs = F.array_sort(F.transform(links, lambda x: F.struct(x["placeId"].alias("id"), x["pos"].alias("pos"))))

    def keep(ps: Column) -> Column:
        firsts = F.filter(ps, lambda p, i: (i == 0) | (F.try_element_at(ps, i)["id"] != p["id"]))
        positions = F.array_sort(F.transform(firsts, lambda p: p["pos"]))
        return F.transform(positions, lambda j: F.element_at(links, j + 1))
    return let(pairs, keep)


@functools.lru_cache(maxsize=1)
def _stage_exprs() -> tuple[Column, ...]:
    """The per-page stage expressions.  They only name columns, so they are
    built once per process (thousands of JVM calls) and reused by every
    query that runs the listing job."""
    links = X.select("elements", lambda e: X.is_tag(e, "a") & X.attr_contains(e, "href", PLACE_LINK))
    return (
        F.transform(links, lambda l, i: F.struct(
            i.alias("pos"), l.alias("el"), resolve_url(X.attr(l, "href"), F.col("url")).alias("href"))),
        F.transform("_l", _with_pid),
        first_wins(F.col("_l")),
        F.filter(F.transform("_l", _container), lambda x: x["cont"].isNotNull()),
        F.transform("_l", _card),
        F.transform("_l", _fields),
    )


def listings(page_elements: DataFrame) -> DataFrame:
    """L1–L12 + W1 over X1 output (``page_id, url, doc_bytes, elements`` and
    any extra page columns, which are carried to every row).

    The first link of each place id wins inside a page *before* links without
    a container or name are dropped, as in the reference."""
    return listing_rows(listing_arrays(page_elements))


def listing_arrays(page_elements: DataFrame) -> DataFrame:
    """One row per page: its columns, ``parse_error`` and the found listings
    as an array — what X1 and the rules have to say about it, in one pass."""
    extra = [c for c in page_elements.columns if c not in ("doc_bytes", "elements", "text_nodes", "parse_error")]
    links, with_pid, w1, with_container, card, fields = _stage_exprs()
    staged = (page_elements.withColumn("_l", links).withColumn("_l", with_pid).withColumn("_l", w1)
              .withColumn("_l", with_container).withColumn("_l", card).withColumn("_l", fields))
    return staged.select(*extra, "parse_error", "_l")


def listing_rows(arrays: DataFrame) -> DataFrame:
    """The listings of :func:`listing_arrays`, one row each."""
    extra = [c for c in arrays.columns if c not in ("parse_error", "_l")]
    rows = explode_rows(arrays, extra, F.col("_l"), "r").select(*[c for c in extra if c != "url"], "r.*")
    rows = rows.filter(F.col("name") != "")
    address = F.when(F.col("_address") != "", F.col("_address")).otherwise(F.col("_fb_address"))
    btype = F.coalesce(F.col("_type"),
                       F.when((F.col("_address") == "") & F.col("_part0").isNotNull() & (F.col("_part0") != ""),
                              F.col("_part0")))
    return (rows.withColumns({"address": F.nullif(address, F.lit("")),
                              "businessType": F.nullif(btype, F.lit("")),
                              "phone": F.nullif("phone", F.lit("")),
                              "pos": F.col("pos").cast("int")})
            .drop("_address", "_fb_address", "_type", "_part0"))
