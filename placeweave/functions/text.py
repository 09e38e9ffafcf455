"""Standardisation rules C1–C15 as native Column expressions.

Every function maps Column → Column and stays inside whole-stage codegen (no
Python UDF).  The rules follow JavaScript string semantics, which differ from
Java's in a few places; the helpers below close those gaps:

* ``WS``: JavaScript ``\\s``/``trim`` include NBSP, U+1680, U+2000–U+200A,
  U+2028/9, U+202F, U+205F, U+3000 and U+FEFF; Java ``\\s`` is ASCII only.
* ``\\z`` instead of ``$``: Java ``$`` also matches before a final newline.
* first-only replacement: JavaScript ``replace`` with a string or a regex
  without ``g`` changes one hit; ``regexp_replace`` changes all, so first-only
  rules are written as ``(?s)\\A(.*?)pattern`` → ``$1…``.
* ``js_length``: JavaScript lengths count UTF-16 units.
* number prefixes: ``parseFloat``/``parseInt`` read a prefix and ANSI casts
  throw, so the prefix is cut by regex and ``try_cast``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The JavaScript whitespace set (the characters matched by
# \s and removed by String.prototype.trim), as a regex class body.
WS_BODY = (r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}"
           r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}")
WS = f"[{WS_BODY}]"
WS_CHARACTERS = ("\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
                 + "\u2028\u2029\u202f\u205f\u3000\ufeff")
NOT_WS = f"[^{WS_BODY}]"

# Characters deleted by the Unicode clean (C1) — C0/C1
# controls, private use U+E000–U+F8FF, specials U+FFF0–U+FFFF and the
# zero-width characters U+200B–U+200D and U+FEFF.
UNICODE_JUNK = r"[\x{0}-\x{1F}\x{7F}-\x{9F}\x{E000}-\x{F8FF}\x{FFF0}-\x{FFFF}\x{200B}-\x{200D}\x{FEFF}]"

SUPPLEMENTARY = r"[^\x{10000}-\x{10FFFF}]"

# Opening-hours words that end an address (C5), as one
# alternation; everything from the earliest of them on is removed.
ADDRESS_TAIL = r"(?is)(?:營業中|已打烊|Opens|Closes|⋅).*\z"

# Shapes of ratings, price ranges and e-mail addresses that
# several rules share.
RATING_WITH_COUNT = rf"^[0-9.]+{WS}*\([0-9,]+\)\z"       # "4.9(200)", "4.6 (2,846)"
PRICE_RANGE = r"^[0-9]{2,3}-[0-9]{2,3}\z"                # "200-400"
EMAIL_IN_TEXT = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
EMAIL_SHAPE_LOOSE = rf"^{NOT_WS.replace(']', '@]')}+@{NOT_WS.replace(']', '@]')}+\.{NOT_WS.replace(']', '@]')}+\z"
EMAIL_SHAPE_STRICT = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\z"
# ASCII word boundary (JavaScript \b); Java's \b is Unicode-aware.
WB_BEFORE = r"(?<![0-9A-Za-z_])"
WB_AFTER = r"(?![0-9A-Za-z_])"


# Strings of JavaScript length (UTF-16 units) below 5: B counts 1, A counts 2.
_B = r"[^\x{10000}-\x{10FFFF}]"
_A = r"[\x{10000}-\x{10FFFF}]"
_SHORT = rf"(?:{_B}{{0,4}}|{_B}{{0,2}}{_A}|{_B}{_A}{_B}|{_A}{_B}{{1,2}}|{_A}{_A})"
JS_SHORTER_THAN_5 = rf"^{_SHORT}\z"
SHORT_OR_NON_ASCII = rf"^(?:{_SHORT}|[\x{{80}}-\x{{10FFFF}}]+)\z"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Catalyst does not share sub-expressions that sit inside ``CASE`` branches,
    so a rule that refers to an intermediate result many times would
    re-generate (and re-run) it per reference; binding it keeps code size and
    work linear."""
    return F.transform(F.array(value), body).getItem(0)


def js_trim(col) -> Column:
    r"""String.prototype.trim: one pass over both ends, no regex (an unanchored
    ``WS+\z`` would be retried at every position of a long whitespace run)."""
    return F.btrim(_c(col), F.lit(WS_CHARACTERS))


def collapse_ws(col, to: str = " ") -> Column:
    """``replace(/\\s+/g, to)`` with the JavaScript whitespace set."""
    return F.regexp_replace(_c(col), f"{WS}+", to)


def js_length(col) -> Column:
    """JavaScript ``length``: UTF-16 code units (astral characters count 2)."""
    c = _c(col)
    return F.length(c) + F.length(F.regexp_replace(c, SUPPLEMENTARY, ""))


def blank_to_null(col) -> Column:
    """JavaScript falsy string → NULL (``x || null``)."""
    return F.nullif(_c(col), F.lit(""))


def float_prefix(col) -> Column:
    """``parseFloat``: leading decimal literal after whitespace, else NULL."""
    return _try_double(_float_literal(_c(col)))


def _try_double(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("double")


def int_prefix(col) -> Column:
    """``parseInt(s, 10)``: leading integer after whitespace, else NULL."""
    lit = F.regexp_extract(_c(col), rf"^{WS}*([+-]?[0-9]+)", 1)
    return F.nullif(lit, F.lit("")).try_cast("long")


def first_only_replace(col, pattern: str, replacement: str, flags: str = "") -> Column:
    """Replace only the first match of ``pattern`` (JavaScript non-global
    ``replace``).  ``replacement`` may use ``$1``… for the pattern's groups."""
    shifted = _shift_groups(replacement)
    return F.regexp_replace(_c(col), rf"(?s{flags})\A(.*?){pattern}", "$1" + shifted)


def _shift_groups(replacement: str) -> str:
    out, i = [], 0
    while i < len(replacement):
        ch = replacement[i]
        if ch == "$" and i + 1 < len(replacement) and replacement[i + 1].isdigit():
            j = i + 1
            while j < len(replacement) and replacement[j].isdigit():
                j += 1
            out.append("$" + str(int(replacement[i + 1:j]) + 1))
            i = j
            continue
        if ch == "\\" and i + 1 < len(replacement):
            out.append(replacement[i:i + 2])
            i += 2
            continue
        out.append(ch)
        i += 1
    return "".join(out)


def literal_first_replace(col, needle: Column, replacement: Column | str = "") -> Column:
    """String ``replace(needle, r)``: first literal occurrence only."""
    c = _c(col)
    rep = F.lit(replacement) if isinstance(replacement, str) else replacement
    pos = F.instr(c, needle)
    head = F.call_function("substring_index", c, needle, F.lit(1))
    tail = c.substr(pos + F.length(needle), F.lit(2147483647))
    return F.when(pos > 0, F.concat(head, rep, tail)).otherwise(c)


# --------------------------------------------------------------------------
# C1 … C15
# --------------------------------------------------------------------------

def clean_unicode(col) -> Column:
    """Delete controls/private use/specials/zero-width, trim, collapse.

    Deletion precedes the collapse, so ``a\\nb`` becomes ``ab``."""
    deleted = F.regexp_replace(_c(col), UNICODE_JUNK + "+", "")
    return F.coalesce(collapse_ws(js_trim(deleted)), F.lit(""))


def standard_type(col, cleaned=None) -> Column:
    """A rating-like or digits-only value is not a business type.

    ``cleaned`` (here and in C4, C5): a column that already holds
    ``clean_unicode(col)``, for jobs that apply several rules to one text."""
    c = _c(col)
    return (F.when(c.isNull() | (c == ""), F.lit(""))
            .when(c.rlike(rf"^[0-9]+\.[0-9]+{WS}*\([0-9]"), F.lit(""))
            .when(c.rlike(rf"^[0-9{WS_BODY}.,()]+\z"), F.lit(""))
            .otherwise(clean_unicode(c) if cleaned is None else _c(cleaned)))


def standard_price(col) -> Column:
    """First run of currency symbols, else a word → ``$$$$``/``$$``/``$``.

    ``inexpensive`` contains ``expensive`` and therefore gives ``$$$$``."""
    c = F.coalesce(_c(col), F.lit(""))
    symbols = F.regexp_extract(c, "[$¥€£₹₩]+", 0)
    return (F.when(symbols != "", symbols)
            .when(c.rlike("(?i)expensive"), F.lit("$$$$"))
            .when(c.rlike("(?i)moderate"), F.lit("$$"))
            .when(c.rlike("(?i)cheap"), F.lit("$"))
            .otherwise(F.lit("")))


def standard_hours(col, cleaned=None) -> Column:
    """C4: tidy one hours text; ``''`` when too short or without any ASCII.

    Written as one linear chain: the 24-hour condition is a lookahead and the
    final length/ASCII test a single replacement, so every step reads its
    input once."""
    c = clean_unicode(col) if cleaned is None else _c(cleaned)
    # fixed values: button captions that stick to the text
    c = F.regexp_replace(c, "(?i)Copy open hours", "")
    c = F.regexp_replace(c, "複製營業時間", "")
    c = F.regexp_replace(c, f"(?i){WB_BEFORE}See more hours{WB_AFTER}", "")
    c = F.regexp_replace(c, f"(?i)·{WS}*See more", "")
    c = F.regexp_replace(c, f",{WS}*複製營業時間", "")
    c = F.regexp_replace(c, f"(?i),{WS}*Copy hours", "")
    c = js_trim(c)
    c = F.regexp_replace(c, f"(?s)^(星期[一二三四五六日])[、，]{WS}*(?=.*24 ?小時營業)", "$1: ")
    c = F.regexp_replace(c, f"(?s)^(週[一二三四五六日])[、，]{WS}*(?=.*24 ?小時營業)", "$1: ")
    c = F.regexp_replace(c, rf",{WS}*\z", "")
    return F.regexp_replace(c, SHORT_OR_NON_ASCII, "")


def _korea_postal(c: Column) -> Column:
    return F.regexp_extract(c, f"{WB_BEFORE}([0-9]{{5}}){WB_AFTER}", 1)


def _korea_move(c: Column) -> Column:
    """Move a 5-digit postal code to the front when it starts in the last
    20 % of the text (JavaScript indices and lengths)."""
    def with_postal(postal: Column) -> Column:
        prefix = F.call_function("substring_index", c, postal, F.lit(1))
        rest = F.concat(prefix, c.substr(F.length(prefix) + 6, F.lit(2147483647)))
        moved = F.concat(postal, F.lit(" "), js_trim(first_only_replace(rest, f",{WS}*,", ",")))
        do_move = (postal != "") & (js_length(prefix) > js_length(c) * F.lit(0.8)) & ~c.startswith(postal)
        return F.when(do_move, moved).otherwise(c)
    return let(_korea_postal(c), with_postal)


def standard_address(col, cleaned=None) -> Column:
    """Clean an address, cut trailing opening-hours text, format Japanese
    and Korean postal codes (Korean code moves to the front only when it
    starts in the last 20 % of the text)."""
    c = clean_unicode(col) if cleaned is None else _c(cleaned)
    c = F.regexp_replace(c, JS_SHORTER_THAN_5, "")
    # cutting at each word in turn = cutting once at the earliest of them
    c = F.regexp_replace(c, ADDRESS_TAIL, "")
    c = js_trim(c)
    c = F.regexp_replace(c, r"(?s)\A(?=.*(?:Japan|日本))(.*?)〒([0-9]{3})-?([0-9]{4})", "$1〒$2-$3")
    return let(c, lambda v: F.when((F.instr(v, "Korea") > 0) | (F.instr(v, "대한민국") > 0), _korea_move(v))
               .otherwise(v))


def standard_name(col) -> Column:
    """Trim and collapse whitespace."""
    return F.coalesce(collapse_ws(js_trim(_c(col))), F.lit(""))


def standard_phone(col, taiwan_brackets: bool = False) -> Column:
    """Price ranges are not phones; keep digits, ``+ - ( )`` and spaces;
    Taiwan numbers with a leading 0 become ``+886 …`` with single spaces.

    Deleting every other character equals joining the runs of kept ones; a
    positive class is several times faster than the negated one in Java's
    engine.  The Taiwan shapes (anchored, cheap) are tested on the kept text
    bound once."""
    c = _c(col)
    sep = f"[{WS_BODY}\\-]"
    kept_runs = F.regexp_extract_all(c, F.lit(rf"[0-9+{WS_BODY}\-()]+"), 0)
    kept = js_trim(F.array_join(kept_runs, ""))
    kept = F.regexp_replace(kept, r"^[^0-9]*\z", "")
    # fixed values: the two Taiwanese shapes
    landline = rf"^0[0-9]{{1,2}}{sep}?[0-9]{{3,4}}{sep}?[0-9]{{3,4}}\z"
    mobile = rf"^09[0-9]{{2}}{sep}?[0-9]{{3}}{sep}?[0-9]{{3}}\z"
    bracket = rf"^\(0([0-9]{{1,2}})\){sep}?([0-9]{{3,4}}){sep}?([0-9]{{3,4}})\z"

    def convert(k: Column) -> Column:
        out = F.when(k.rlike(landline) | k.rlike(mobile),
                     F.regexp_replace(F.regexp_replace(k, "^0", "+886 "), f"{sep}+", " "))
        if taiwan_brackets:
            out = out.when(k.rlike(bracket), F.regexp_replace(k, bracket, "+886 $1 $2 $3"))
        return out.otherwise(k)
    return (F.when(c.isNull() | (c == ""), F.lit(""))
            .when(c.rlike(PRICE_RANGE), F.lit(""))
            .otherwise(let(kept, convert)))


def compact_address(col) -> Column:
    """Rating-like ⇒ ``''``; otherwise remove every whitespace."""
    c = _c(col)
    return (F.when(c.isNull() | (c == ""), F.lit(""))
            .when(c.rlike(RATING_WITH_COUNT), F.lit(""))
            .otherwise(F.regexp_replace(c, f"{WS}+", "")))


def standard_website(col) -> Column:
    """Add ``https://`` (``https://www.`` for facebook.com), cut at ``?``."""
    c = js_trim(_c(col))
    with_scheme = (F.when(c.rlike("^https?://"), c)
                   .when(F.instr(c, "facebook.com") > 0, F.concat(F.lit("https://www."), c))
                   .otherwise(F.concat(F.lit("https://"), c)))
    out = F.substring_index(with_scheme, "?", 1)
    return F.when(_c(col).isNull() | (_c(col) == ""), F.lit("")).otherwise(out)


def is_email(col) -> Column:
    """Loose e-mail shape test; NULL ⇒ false."""
    return F.coalesce(_c(col).rlike(EMAIL_SHAPE_LOOSE), F.lit(False))


def extract_emails(col) -> Column:
    """C11: all e-mails in a text, distinct, first-seen order, case kept."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(_c(col), F.lit(EMAIL_IN_TEXT), 0)),
                      F.array().cast("array<string>"))


def standard_rating(col) -> Column:
    """Prefix number (non-number ⇒ 0), clamp to 0–5, one decimal half-up."""
    c = _c(col)
    num = F.coalesce(_try_double(_float_literal(c.cast("string"))), F.lit(0.0))
    num = F.when(F.isnan(num), F.lit(0.0)).otherwise(num)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(5.0), num))
    return F.floor(clamped * 10 + 0.5) / 10


def _float_literal(c: Column) -> Column:
    return F.regexp_extract(
        c, rf"^{WS}*([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))", 1)


def standard_reviews(col) -> Column:
    """Drop ``, ( )``, read a prefix integer, else 0 (``1.5K`` → 1)."""
    c = F.translate(_c(col).cast("string"), ",()", "")
    return F.coalesce(int_prefix(c), F.lit(0).cast("long"))


def strict_type(col) -> Column:
    """C14: trimmed type; rating-like or all-``$`` ⇒ ``''``."""
    t = js_trim(_c(col))
    return (F.when(_c(col).isNull() | (_c(col) == ""), F.lit(""))
            .when(t.rlike(RATING_WITH_COUNT), F.lit(""))
            .when(t.rlike(r"^\$+\z"), F.lit(""))
            .otherwise(t))


def standardise(df, columns: dict[str, str] | None = None):
    """Apply the standard rule to each business column present in ``df``.

    ``columns`` maps column name → rule name; the default covers the
    business schema.  Unknown columns are left as they are.
    """
    rules = {
        "name": standard_name, "businessType": strict_type, "priceLevel": standard_price,
        "address": standard_address, "phone": standard_phone, "website": standard_website,
        "rating": standard_rating, "reviews": standard_reviews,
    }
    mapping = columns or {k: k for k in rules}
    out = df
    for column, rule in mapping.items():
        if column in df.columns:
            out = out.withColumn(column, rules[rule](F.col(column)))
    return out
