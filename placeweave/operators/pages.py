"""Page → text and page → link rows (X2, X3) as native expressions.

Both operators are narrow: they run per page row inside whole-stage codegen
and never shuffle, so they scale with the number of scan partitions.  The
input is the captured-page table ``(page_id, url, html)`` (O8).
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HS = r"[ \t\n\f\r]"  # HTML whitespace, spelled out so Java and RE2 agree

# Elements whose content is never rendered as text.
HIDDEN_BLOCKS = ("script", "style", "noscript", "template")
# Elements whose content the HTML parser never turns into
# elements (raw text / RCDATA / inert template content).
NON_MARKUP_BLOCKS = ("script", "style", "noscript", "template", "textarea", "title")
# Tags that start a new line in rendered text.
BLOCK_TAGS = ("address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|"
              "form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tbody|thead|tfoot|"
              "title|tr|ul")

# A construct that is never closed runs to the end of the page in the same
# match, as in a parser: no opener is scanned twice, so time stays linear.
END = r"(?:>|\z)"
BODY_START = rf"(?is)^.*?<body(?:{HS}[^>]*)?{END}"
BLOCK_TAG = rf"(?i)</?(?:{BLOCK_TAGS})(?:[ \t\n\f\r/][^>]*)?{END}"
CELL_TAG = rf"(?i)</?t[dh](?:[ \t\n\f\r/][^>]*)?{END}"
ANY_TAG = rf"<[/!?]?[a-zA-Z][^>]*{END}"
HTML_SPACE = r"[ \t\n\r\f]+"
ANCHOR_TAG = rf"(?is)<a{HS}[^>]*{END}"
HREF_DQ = rf"""(?is)[ \t\n\f\r"']href{HS}*={HS}*"([^"]*)\""""
HREF_SQ = rf"""(?is)[ \t\n\f\r"']href{HS}*={HS}*'([^']*)'"""
HREF_BARE = rf"""(?is)[ \t\n\f\r"']href{HS}*={HS}*([^ \t\n\f\r"'>]+)"""
URL_ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)"
URL_DIR = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(/[^?#]*/)?"
URL_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _strip_pattern(tags) -> str:
    """One pass removing comments and the given blocks: an alternation, so
    the leftmost construct wins as a parser would see it."""
    blocks = "|".join(rf"<{t}(?:{HS}[^>]*)?(?:\z|>.*?(?:</{t}(?:[ \t\n\f\r/][^>]*)?{END}|\z))" for t in tags)
    return rf"(?is)<!--.*?(?:-->|\z)|{blocks}"


HIDDEN_STRIP = _strip_pattern(HIDDEN_BLOCKS)
NON_MARKUP_STRIP = _strip_pattern(NON_MARKUP_BLOCKS)


# Named character references: the standard library's table of HTML names, and
# (fixed values) the names of ASCII marks that addresses are written with.
NAMED_REFERENCES = {name: chr(point) for name, point in name2codepoint.items()} | {
    "apos": "'", "commat": "@", "period": ".", "lowbar": "_", "plus": "+", "colon": ":", "sol": "/", "num": "#",
    "lpar": "(", "rpar": ")", "comma": ",", "excl": "!", "quest": "?", "equals": "=", "percnt": "%", "dollar": "$"}
DECIMAL_REFERENCE = r"^#([0-9]{1,7});?"
HEX_REFERENCE = r"^#[xX]([0-9a-fA-F]{1,6});?"
NAMED_REFERENCE = r"^([a-zA-Z][a-zA-Z0-9]{1,9});"


def decode_entities(col) -> Column:
    """Decode character references: decimal, hexadecimal and named ones, each
    once (``&amp;lt;`` becomes ``&lt;``).  Unknown names stay; a number that is
    no character becomes U+FFFD."""
    from placeweave.functions.text import let

    names = F.create_map(*[F.lit(x) for pair in NAMED_REFERENCES.items() for x in pair])

    def character(code: Column) -> Column:
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))

    def piece(p: Column, i: Column) -> Column:
        named = F.try_element_at(names, F.regexp_extract(p, NAMED_REFERENCE, 1))
        return (F.when(i == 0, p)
                .when(p.rlike(DECIMAL_REFERENCE), F.concat(
                    character(F.regexp_extract(p, DECIMAL_REFERENCE, 1).cast("long")),
                    F.regexp_replace(p, DECIMAL_REFERENCE, "")))
                .when(p.rlike(HEX_REFERENCE), F.concat(
                    character(F.conv(F.regexp_extract(p, HEX_REFERENCE, 1), 16, 10).cast("long")),
                    F.regexp_replace(p, HEX_REFERENCE, "")))
                .when(named.isNotNull(), F.concat(named, F.regexp_replace(p, NAMED_REFERENCE, "")))
                .otherwise(F.concat(F.lit("&"), p)))

    return let(_c(col), lambda c: F.when(F.instr(c, "&") > 0, F.array_join(F.transform(F.split(c, "&"), piece), ""))
               .otherwise(c))


def visible_text_expr(html) -> Column:
    """Approximate ``document.body.innerText`` of a page.

    Comments and script/style/noscript/template go first (tags inside them
    mean nothing), then all before the body; what follows ``</body>`` stays, as
    a parser moves it into the body.  Source whitespace is collapsed; block
    tags become line breaks, cells tabs; the remaining tags vanish; character
    references are decoded."""
    c = F.regexp_replace(_c(html), HIDDEN_STRIP, "")
    c = F.regexp_replace(c, BODY_START, "")
    c = F.regexp_replace(c, HTML_SPACE, " ")
    c = F.regexp_replace(c, BLOCK_TAG, "\n")
    c = F.regexp_replace(c, CELL_TAG, "\t")
    c = F.regexp_replace(c, ANY_TAG, "")
    c = decode_entities(c)
    c = F.regexp_replace(c, r"[ \t]*\n[ \t\n]*", "\n")
    return F.btrim(c, F.lit(" \t\n"))


def page_text(pages: DataFrame) -> DataFrame:
    """X2 as a table job: ``(page_id, url, text)``."""
    return pages.select("page_id", "url", visible_text_expr("html").alias("text"))


def markup_only(html) -> Column:
    """The HTML without comments and without the content of raw-text blocks,
    so tag regexes see only what the parser would make elements of."""
    return F.regexp_replace(_c(html), NON_MARKUP_STRIP, "")


def anchor_tags_expr(html) -> Column:
    """Every ``<a …>`` start tag that carries an ``href``, in document order."""
    tags = F.regexp_extract_all(markup_only(html), F.lit(ANCHOR_TAG), 0)
    return F.filter(tags, lambda t: t.endswith(">") & (t.rlike(HREF_DQ) | t.rlike(HREF_SQ) | t.rlike(HREF_BARE)))


def anchor_hrefs_expr(html) -> Column:
    """The ``href`` attribute of every ``<a>`` start tag, in document order
    (anchors without ``href`` are skipped), entities decoded."""
    def href_of(tag: Column) -> Column:
        return F.coalesce(
            F.when(tag.rlike(HREF_DQ), F.regexp_extract(tag, HREF_DQ, 1)),
            F.when(tag.rlike(HREF_SQ), F.regexp_extract(tag, HREF_SQ, 1)),
            F.when(tag.rlike(HREF_BARE), F.regexp_extract(tag, HREF_BARE, 1)))
    tags = F.filter(F.regexp_extract_all(markup_only(html), F.lit(ANCHOR_TAG), 0), lambda t: t.endswith(">"))
    hrefs = F.filter(F.transform(tags, href_of), lambda h: h.isNotNull())
    return F.transform(hrefs, decode_entities)


def resolve_url(href, base) -> Column:
    """``a.href``: resolve a link against the page URL (no dot-segment
    normalisation).  ``href`` is bound once (see :func:`let`)."""
    from placeweave.functions.text import let

    b = _c(base)
    origin = F.regexp_extract(b, URL_ORIGIN, 1)
    scheme = F.regexp_extract(b, URL_SCHEME, 1)
    directory = F.concat(origin, F.coalesce(F.nullif(F.regexp_extract(b, URL_DIR, 1), F.lit("")),
                                            F.lit("/")))
    no_frag = F.substring_index(b, "#", 1)
    no_query = F.substring_index(no_frag, "?", 1)
    return let(_c(href), lambda h: (
        F.when(h.rlike(URL_SCHEME), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(no_query, h))
        .when(h.startswith("#"), F.concat(no_frag, h))
        .when(h == "", no_frag)
        .otherwise(F.concat(directory, h))))


def page_links(pages: DataFrame, contains: str | None = None) -> DataFrame:
    """``(page_id, pos, href, link_url)`` in document order, ``pos`` from 0.

    ``contains`` keeps only links whose resolved URL contains the text (the
    listing rule uses ``/maps/place/``)."""
    links = (pages.select("page_id", "url", F.posexplode(anchor_hrefs_expr("html")).alias("pos", "href"))
             .select("page_id", "pos", "href", resolve_url("href", "url").alias("link_url")))
    if contains is not None:
        links = links.filter(F.col("link_url").contains(contains))
    return links
