"""Phone number in a block of text, by a priority list of patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave.functions.text import PRICE_RANGE, WS_BODY, js_trim

_SEP = f"[{WS_BODY}\\-]"
# The five phone shapes, in priority order — Taiwan
# international, Taiwan local with area code in brackets, Taiwan local with
# separators, generic international, and mobile 4-3-3.
PHONE_PATTERNS = (
    rf"(\+886{_SEP}?[0-9]{{1,2}}{_SEP}?[0-9]{{3,4}}{_SEP}?[0-9]{{3,4}})",
    rf"(\([0-9]{{2}}\){_SEP}?[0-9]{{3,4}}{_SEP}?[0-9]{{3,4}})",
    rf"([0-9]{{2}}{_SEP}[0-9]{{4}}{_SEP}[0-9]{{4}})",
    rf"(\+[0-9]{{1,3}}{_SEP}?\(?[0-9]{{1,4}}\)?{_SEP}?[0-9]{{3,4}}{_SEP}?[0-9]{{3,4}})",
    rf"([0-9]{{4}}{_SEP}[0-9]{{3}}{_SEP}[0-9]{{3}})",
)


def first_phone_expr(text) -> Column:
    """The first pattern whose first hit is not a price range wins; NULL if none.

    Each candidate reads its hit once: a price-range look-alike is blanked by
    an anchored replacement and ``nullif`` hands over to the next pattern."""
    c = F.col(text) if isinstance(text, str) else text
    candidates = [F.nullif(F.regexp_replace(js_trim(F.regexp_extract(c, pattern, 1)), PRICE_RANGE, ""), F.lit(""))
                  for pattern in PHONE_PATTERNS]
    return F.coalesce(*candidates)
