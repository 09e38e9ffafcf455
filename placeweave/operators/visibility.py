"""X2 with visibility: the text that a page shows.

``innerText`` leaves out what is not rendered.  On the element table that is
interval work: the subtree of a hidden element is one run of elements and one
byte range of the page's text, so the text shown is the page's text less those
ranges, read once from front to back.  Blocks stand on lines of their own,
cells behind tabs, white space is collapsed outside ``pre``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from placeweave.functions.arrow import map_column
from placeweave.operators.elements import flatten_page

# Elements that are never shown, and those on lines of their own.
NEVER_SHOWN = frozenset("head title script style noscript template meta link base area datalist param rp track source".split())
BLOCKS = frozenset(("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer "
                    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
                    "section summary table tbody tfoot thead tr ul").split())
CELLS = frozenset(("td", "th"))
_HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|content-visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


def is_hidden(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element (and all in it) is not shown, as far as its own
    markup says."""
    return (tag in NEVER_SHOWN or "hidden" in attrs or tag == "input" or tag == "dialog" and "open" not in attrs
            or bool(_HIDDEN_STYLE.search(attrs.get("style", ""))))


def hidden_ranges(rows: list[list]) -> list[tuple[int, int]]:
    """Byte ranges of hidden subtrees, disjoint and in order; a hidden
    subtree's elements are skipped as one run."""
    out, at = [], 0
    while at < len(rows):
        _, _, _, last, tag, attrs, t0, t1 = rows[at]
        if is_hidden(tag, attrs):
            if t1 > t0:
                out.append((t0, t1))
            at = last + 1
        else:
            at += 1
    return out


def shown_text(html: str | None) -> str:
    """The text that a page shows (``""`` for a null or unreadable page)."""
    text, rows, nodes, error = flatten_page(html)
    if error is not None:
        return ""
    breaks: dict[int, str] = {}                 # byte offset → what stands there
    pre: list[tuple[int, int]] = []
    at = 0
    while at < len(rows):
        _, _, _, last, tag, attrs, t0, t1 = rows[at]
        if is_hidden(tag, attrs):
            at = last + 1
            continue
        if tag in BLOCKS:
            breaks[t0] = breaks[t1] = "\n"
            if tag == "pre":
                pre.append((t0, t1))
        elif tag in CELLS:
            breaks.setdefault(t0, "\t")
            breaks.setdefault(t1, "\t")
        at += 1
    out: list[str] = []
    hidden = iter(hidden_ranges(rows))
    kept = iter(pre)
    a, b = next(hidden, (len(text) + 1, 0))
    p0, p1 = next(kept, (len(text) + 1, 0))
    for t0, t1 in nodes:
        while b and b <= t0:
            a, b = next(hidden, (len(text) + 1, 0))
        while p1 and p1 <= t0:
            p0, p1 = next(kept, (len(text) + 1, 0))
        if t0 in breaks:
            out.append(breaks[t0])
        if not a <= t0:                          # a node lies in a hidden range or outside of all
            piece = text[t0:t1].decode("utf-8")
            if p0 > t0:
                piece = _SPACES.sub(" ", piece)
                if piece[0] == " " and out and out[-1][-1:] in (" ", "\n", "\t"):
                    piece = piece[1:]            # one space between two pieces of text
            out.append(piece)
        if t1 in breaks:
            out.append(breaks[t1])
    lines = "".join(out)
    return re.sub(r"[ \t]*\n[ \t\n]*", "\n", lines).strip(" \t\n")


def shown_texts(pages: DataFrame, html: str = "html", name: str = "shown") -> DataFrame:
    """All columns of ``pages`` with the text shown in place of ``html``; one
    narrow Arrow pass."""
    return map_column(pages, html, lambda h: (shown_text(h),), {name: "string"})
