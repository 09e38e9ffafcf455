"""DuckDB SQL fragments for the oracle queries.

The correctness gate runs each Spark query next to an ANSI-SQL twin in
DuckDB.  These builders spell the same rules in DuckDB's dialect: RE2 regexes
(no lookaround, ``\\1`` in replacements, first-only unless ``'g'``),
``list_*`` lambdas (``lambda x: …``) and an order-keeping distinct.
"""

from __future__ import annotations

from placeweave.functions import text as T
from placeweave.operators import pages as P


def q(s: str) -> str:
    """SQL string literal (DuckDB strings keep backslashes as they are)."""
    return "'" + s.replace("'", "''") + "'"


def _rep(r: str) -> str:
    out, i = [], 0
    while i < len(r):
        if r[i] == "$" and i + 1 < len(r) and r[i + 1].isdigit():
            out.append("\\" + r[i + 1])
            i += 2
            continue
        out.append(r[i])
        i += 1
    return "".join(out)


def rx_all(x: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(_rep(repl))}, 'g')"


def rx_first(x: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(_rep(repl))})"


def rlike(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def extract(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def ordered_distinct(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


# ---- text rules ----------------------------------------------------------

def js_trim(x: str) -> str:
    return rx_all(x, rf"^{T.WS}+|{T.WS}+\z")


def collapse_ws(x: str, to: str = " ") -> str:
    return rx_all(x, f"{T.WS}+", to)


def js_length(x: str) -> str:
    return f"(length({x}) + length({rx_all(x, T.SUPPLEMENTARY)}))"


def clean_unicode(x: str) -> str:
    return f"coalesce({collapse_ws(js_trim(rx_all(x, T.UNICODE_JUNK)))}, '')"


def standard_name(x: str) -> str:
    return f"coalesce({collapse_ws(js_trim(x))}, '')"


def compact_address(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' WHEN {rlike(x, T.RATING_WITH_COUNT)} THEN '' "
            f"ELSE {rx_all(x, T.WS)} END")


def standard_type(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' "
            f"WHEN {rlike(x, rf'^[0-9]+\.[0-9]+{T.WS}*\([0-9]')} THEN '' "
            f"WHEN {rlike(x, rf'^[0-9{T.WS_BODY}.,()]+\z')} THEN '' ELSE {clean_unicode(x)} END")


def standard_price(x: str) -> str:
    c = f"coalesce({x}, '')"
    sym = extract(c, "[$¥€£₹₩]+", 0)
    return (f"CASE WHEN {sym} <> '' THEN {sym} WHEN {rlike(c, '(?i)expensive')} THEN '$$$$' "
            f"WHEN {rlike(c, '(?i)moderate')} THEN '$$' WHEN {rlike(c, '(?i)cheap')} THEN '$' ELSE '' END")


# JavaScript \b around an ASCII phrase, without lookaround: the phrase must be
# preceded by start or a non-word character that is kept.
def _phrase_wb(x: str, phrase: str) -> str:
    return rx_all(x, f"(?i)(^|[^0-9A-Za-z_]){phrase}([^0-9A-Za-z_]|\\z)", "$1$2")


def standard_hours(x: str) -> str:
    c = clean_unicode(x)
    c = rx_all(c, "(?i)Copy open hours")
    c = rx_all(c, "複製營業時間")
    c = _phrase_wb(c, "See more hours")
    c = rx_all(c, f"(?i)·{T.WS}*See more")
    c = rx_all(c, f",{T.WS}*複製營業時間")
    c = rx_all(c, f"(?i),{T.WS}*Copy hours")
    c = js_trim(c)
    is24 = f"(strpos({c}, '24 小時營業') > 0 OR strpos({c}, '24小時營業') > 0)"
    c = (f"CASE WHEN {is24} THEN "
         f"{rx_first(rx_first(c, f'^(星期[一二三四五六日])[、，]{T.WS}*', '$1: '), f'^(週[一二三四五六日])[、，]{T.WS}*', '$1: ')}"
         f" ELSE {c} END")
    c = rx_all(c, rf",{T.WS}*\z")
    return f"CASE WHEN {js_length(c)} < 5 OR {rlike(c, r'^[\x{80}-\x{10FFFF}]+\z')} THEN '' ELSE {c} END"


def standard_phone(x: str) -> str:
    kept = js_trim(rx_all(x, rf"[^0-9+{T.WS_BODY}\-()]"))
    sep = f"[{T.WS_BODY}\\-]"
    landline = rf"^0[0-9]{{1,2}}{sep}?[0-9]{{3,4}}{sep}?[0-9]{{3,4}}\z"
    mobile = rf"^09[0-9]{{2}}{sep}?[0-9]{{3}}{sep}?[0-9]{{3}}\z"
    intl = rx_all(rx_first(kept, "^0", "+886 "), f"{sep}+", " ")
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' WHEN {rlike(x, T.PRICE_RANGE)} THEN '' "
            f"WHEN NOT {rlike(kept, '[0-9]')} THEN '' "
            f"WHEN {rlike(kept, landline)} OR {rlike(kept, mobile)} THEN {intl} ELSE {kept} END")


def standard_website(x: str) -> str:
    c = js_trim(x)
    ws = (f"CASE WHEN {rlike(c, '^https?://')} THEN {c} WHEN strpos({c}, 'facebook.com') > 0 "
          f"THEN 'https://www.' || {c} ELSE 'https://' || {c} END")
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' ELSE split_part({ws}, '?', 1) END"


def is_email(x: str) -> str:
    return f"coalesce({rlike(x, T.EMAIL_SHAPE_LOOSE)}, false)"


def extract_emails(x: str) -> str:
    lst = f"regexp_extract_all({x}, {q(T.EMAIL_IN_TEXT)}, 0)"
    return f"coalesce({ordered_distinct(lst)}, [])"


def float_literal(x: str) -> str:
    return extract(x, rf"^{T.WS}*([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))", 1)


def standard_rating(x: str) -> str:
    num = f"coalesce(try_cast(nullif({float_literal(f'CAST({x} AS VARCHAR)')}, '') AS DOUBLE), 0.0)"
    num = f"(CASE WHEN isnan({num}) THEN 0.0 ELSE {num} END)"
    return f"(floor(greatest(0.0, least(5.0, {num})) * 10 + 0.5) / 10)"


def int_prefix(x: str) -> str:
    return f"try_cast(nullif({extract(x, rf'^{T.WS}*([+-]?[0-9]+)', 1)}, '') AS BIGINT)"


def standard_reviews(x: str) -> str:
    return f"coalesce({int_prefix(f'translate(CAST({x} AS VARCHAR), {q(",()")}, {q("")})')}, 0)"


def strict_type(x: str) -> str:
    t = js_trim(x)
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' WHEN {rlike(t, T.RATING_WITH_COUNT)} THEN '' "
            f"WHEN {rlike(t, r'^\$+\z')} THEN '' ELSE {t} END")


# ---- page rules ------------------------------------------------------------

def decode_entities(x: str) -> str:
    # spelled without the Spark side's patterns: the text after each '&' up to
    # its ';' is looked up in Python's own table or read as a number
    from html.entities import name2codepoint

    known = {n: chr(p) for n, p in name2codepoint.items()} | {"apos": "'", "commat": "@", "period": "."}
    names = "MAP {" + ", ".join(f"{q(n)}: {q(c)}" for n, c in known.items()) + "}"
    head = "split_part(p, ';', 1)"
    rest = f"substr(p, length({head}) + 2)"
    number = f"CAST(CASE WHEN ({head})[2] IN ('x', 'X') THEN '0x' || ({head})[3:] ELSE ({head})[2:] END AS INTEGER)"
    return (f"array_to_string(list_transform(string_split({x}, '&'), lambda p, i: CASE WHEN i = 1 THEN p "
            f"WHEN strpos(p, ';') > 0 AND regexp_full_match({head}, '#([0-9]+|[xX][0-9a-fA-F]+)') THEN chr({number}) || {rest} "
            f"WHEN strpos(p, ';') > 0 AND {names}[{head}] IS NOT NULL THEN {names}[{head}] || {rest} "
            f"ELSE '&' || p END), '')")


def visible_text(html: str) -> str:
    c = rx_all(html, P.HIDDEN_STRIP)
    c = rx_all(c, P.BODY_START)
    c = rx_all(c, P.HTML_SPACE, " ")
    c = rx_all(c, P.BLOCK_TAG, "\n")
    c = rx_all(c, P.CELL_TAG, "\t")
    c = rx_all(c, P.ANY_TAG)
    c = decode_entities(c)
    c = rx_all(c, r"[ \t]*\n[ \t\n]*", "\n")
    return rx_all(c, r"^[ \t\n]+|[ \t\n]+\z")


def markup_only(html: str) -> str:
    return rx_all(html, P.NON_MARKUP_STRIP)


def anchor_tags(html: str) -> str:
    tags = f"regexp_extract_all({markup_only(html)}, {q(P.ANCHOR_TAG)}, 0)"
    return (f"list_filter({tags}, lambda t: ends_with(t, '>') AND ({rlike('t', P.HREF_DQ)} OR {rlike('t', P.HREF_SQ)} "
            f"OR {rlike('t', P.HREF_BARE)}))")


def anchor_hrefs(html: str) -> str:
    def href_of(t: str) -> str:
        return (f"CASE WHEN {rlike(t, P.HREF_DQ)} THEN {extract(t, P.HREF_DQ, 1)} "
                f"WHEN {rlike(t, P.HREF_SQ)} THEN {extract(t, P.HREF_SQ, 1)} "
                f"WHEN {rlike(t, P.HREF_BARE)} THEN {extract(t, P.HREF_BARE, 1)} END")
    tags = f"regexp_extract_all({markup_only(html)}, {q(P.ANCHOR_TAG)}, 0)"
    hrefs = (f"list_filter(list_transform(list_filter({tags}, lambda t: ends_with(t, '>')), lambda t: {href_of('t')}), "
             f"lambda h: h IS NOT NULL)")
    return f"list_transform({hrefs}, lambda h: {decode_entities('h')})"


def resolve_url(h: str, b: str) -> str:
    origin = extract(b, P.URL_ORIGIN, 1)
    scheme = extract(b, P.URL_SCHEME, 1)
    directory = f"({origin} || coalesce(nullif({extract(b, P.URL_DIR, 1)}, ''), '/'))"
    no_frag = f"split_part({b}, '#', 1)"
    no_query = f"split_part({no_frag}, '?', 1)"
    return (f"CASE WHEN {rlike(h, P.URL_SCHEME)} THEN {h} "
            f"WHEN starts_with({h}, '//') THEN {scheme} || ':' || {h} "
            f"WHEN starts_with({h}, '/') THEN {origin} || {h} "
            f"WHEN starts_with({h}, '?') THEN {no_query} || {h} "
            f"WHEN starts_with({h}, '#') THEN {no_frag} || {h} "
            f"WHEN {h} = '' THEN {no_frag} ELSE {directory} || {h} END")


def text_emails(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, {q(T.EMAIL_IN_TEXT)}, 0), lambda e: lower(e))"


def mailto_emails(html: str) -> str:
    hrefs = f"list_filter({anchor_hrefs(html)}, lambda h: starts_with(h, 'mailto:'))"
    em = f"list_transform({hrefs}, lambda h: lower(split_part(substr(h, 8), '?', 1)))"
    return f"list_filter({em}, lambda e: e <> '')"


def blacklisted(e: str) -> str:
    from placeweave.operators.emails import EMAIL_BLACKLIST

    return "(" + " OR ".join(f"strpos(lower({e}), {q(w)}) > 0" for w in EMAIL_BLACKLIST) + ")"


def standard_address(x: str) -> str:
    c0 = clean_unicode(x)
    c = c0
    c = rx_all(c, T.ADDRESS_TAIL)
    c = js_trim(c)
    c = (f"CASE WHEN strpos({c}, 'Japan') > 0 OR strpos({c}, '日本') > 0 "
         f"THEN {rx_first(c, '〒([0-9]{3})-?([0-9]{4})', '〒$1-$2')} ELSE {c} END")
    postal = extract(c, "(^|[^0-9A-Za-z_])([0-9]{5})([^0-9A-Za-z_]|\\z)", 2)
    prefix = f"CASE WHEN {postal} <> '' THEN split_part({c}, {postal}, 1) ELSE '' END"
    rest = f"({prefix} || substr({c}, length({prefix}) + 6))"
    moved = f"({postal} || ' ' || {js_trim(rx_first(rest, f',{T.WS}*,', ','))})"
    korea = f"(strpos({c}, 'Korea') > 0 OR strpos({c}, '대한민국') > 0)"
    do_move = (f"({korea} AND {postal} <> '' AND {js_length(prefix)} > {js_length(c)} * CAST(0.8 AS DOUBLE) "
               f"AND NOT starts_with({c}, {postal}))")
    return f"CASE WHEN {js_length(c0)} < 5 THEN '' WHEN {do_move} THEN {moved} ELSE {c} END"
