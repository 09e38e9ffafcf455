"""Detail-page extraction (D1–D12) on the X1 element table.

One row per captured detail page → ``address, phone, website, hours,
hoursDetail, hours_entries, priceLevel, businessType``.  Like the listing
job it is narrow: per-page candidate lists are built once, each rule then
scans those lists with higher-order expressions.  The "click the hours
button, read the panel" step of a live browser becomes "read the first hours
panel present in the captured page".
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions.text import (WS, WS_BODY, collapse_ws, first_only_replace, js_length, js_trim, let,
                                       literal_first_replace)
from placeweave.functions.arrays import size0
from placeweave.operators import elements as X
from placeweave.operators import hours as H
from placeweave.operators.pages import resolve_url

# Weekday words that mark a table row as a day row.
DAY_WORDS = r"(?i)Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
COPY_HOURS = "複製營業時間"
FULL_DAY_TEXT = "24 小時營業"
# Text of a button that looks like an hours button.
HOURS_BUTTON_TEXT = rf"[0-9]{{1,2}}[:][0-9]{{2}}|AM|PM|Open|Closed|⋅|24{WS}*小時|24{WS}*hours"
LIST_DAY = r"^(星期[一二三四五六日]|週[一二三四五六日]|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)"
# Hours fallbacks D5–D7.
TIMEISH = r"[0-9]{1,2}[:][0-9]{2}|AM|PM|am|pm|時|点|시|giờ|Open|Closed|營業|打烊"
AMPM_TIME = rf"[0-9]{{1,2}}{WS}*(:|：){WS}*[0-9]{{2}}{WS}*(AM|PM|am|pm)"
FACILITY_WORDS = ("自助餐廳", "泳池", "健身", "餐廳", "Pool", "Gym", "Restaurant", "Buffet", "Spa", "Bar", "Lounge",
                  "酒吧", "大廳", "Lobby")
MAIN_HOURS_WORDS = ("24", "週", "Monday", "星期", "Daily", "每日", "Open", "營業")
STATUS_WORDS = ("Open", "Closed", "營業中", "已打烊", "열림", "닫힘")
PRIVATE_USE = r"[\x{E000}-\x{F8FF}]"
EMOJI_PLANE = r"[\x{1F000}-\x{1FFFF}]"
# Address, phone and website labels.
ADDRESS_LABEL = rf"(?i)^(Address|地址|주소|Địa chỉ|住所):{WS}*"
# Price words in four languages (D11, stage 6), highest first.
PRICE_WORDS = (
    ("$$$$", ("very expensive", "非常昂貴")),
    ("$$$", ("expensive", "昂貴", "高価", "비싼")),
    ("$$", ("moderate", "中等", "普通", "보통")),
    ("$", ("inexpensive", "cheap", "便宜", "安い", "저렴")),
)
PRICE_LABELS = (("span", "Price level"), ("span", "price level"), ("button", "Price level"),
                ("span", "價格級別"), ("span", "가격 수준"))
STAR_CLASS = rf"[0-9]{WS}*[星☆]{WS}*級"

DETAIL_SCHEMA = ("page_id BIGINT, address STRING, phone STRING, website STRING, hours ARRAY<STRING>, "
                 "hoursDetail MAP<STRING,STRING>, priceLevel STRING, businessType STRING")


def _any_contains(c: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | (F.instr(c, w) > 0)
    return hit


def _txt(e: Column) -> Column:
    return X.text_of(e)


def _first(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))


def _clean_hours_text(c: Column, drop_emoji: bool = False) -> Column:
    c = F.regexp_replace(c, PRIVATE_USE, "")
    if drop_emoji:
        c = F.regexp_replace(c, EMOJI_PLANE, "")
    return js_trim(collapse_ws(c))


@functools.lru_cache(maxsize=1)
def _candidate_exprs() -> tuple[list[Column], Column, Column]:
    """Per-page candidate lists, the hours panel and the first hours button
    (built once per process: they only name columns)."""
    els = F.col("elements")      # fixed values below: the captured pages' tags and attribute texts

    def tag(name):
        return X.select(els, lambda e: X.is_tag(e, name))

    def has_ancestor(cands_col: str, e: Column) -> Column:
        return F.exists(F.col(cands_col), lambda a: (a["idx"] < e["idx"]) & (e["idx"] <= a["last"]))

    cols = [
        tag("table").alias("_tables"),
        tag("button").alias("_buttons"), tag("span").alias("_spans"), tag("a").alias("_anchors"),
        X.select(els, lambda e: e["tag"].isin("button", "div", "span")).alias("_bds"),
        X.select(els, lambda e: e["tag"].isin("span", "div")).alias("_sds"),
        X.select(els, lambda e: X.is_tag(e, "div") & X.attr_equals(e, "role", "dialog")).alias("_dialogs"),
        X.select(els, lambda e: X.is_tag(e, "div") & X.attr_contains(e, "class", "hour")).alias("_hourdivs"),
        X.select(els, lambda e: X.is_tag(e, "body")).alias("_body"),
    ]
    # Hours panel container: table.hour, dialog table, div.hour ul, table tbody.
    panel = F.coalesce(
        _first(F.filter("_tables", lambda t: X.attr_contains(t, "class", "hour"))),
        _first(F.filter("_tables", lambda t: has_ancestor("_dialogs", t))),
        _first(X.select(els, lambda e: X.is_tag(e, "ul") & has_ancestor("_hourdivs", e))),
        _first(X.select(els, lambda e: X.is_tag(e, "tbody") & has_ancestor("_tables", e))))
    first_button = F.coalesce(
        _first(F.filter("_buttons", lambda b: X.attr_contains(b, "data-item-id", "hour"))),
        _first(F.filter("_buttons", lambda b: X.attr_contains(b, "aria-label", "Hours"))),
        _first(F.filter("_buttons", lambda b: X.attr_contains(b, "aria-label", "hours"))),
        _first(F.filter("_buttons", lambda b: X.attr_contains(b, "aria-label", "營業時間"))),
        _first(X.select(els, lambda e: X.is_tag(e, "div") & X.attr_contains(e, "aria-label", "Hours"))),
        _first(F.filter("_buttons", lambda b: F.concat(F.coalesce(_txt(b), F.lit("")),
                                                       F.coalesce(X.attr(b, "aria-label"), F.lit("")))
                        .rlike(HOURS_BUTTON_TEXT))))
    return cols, panel, first_button


def _candidates(df: DataFrame) -> DataFrame:
    cols, panel, first_button = _candidate_exprs()
    return df.select("*", *cols).withColumn("_panel", panel).withColumn("_hbtn", first_button)


def _row_cells(row: Column) -> Column:
    """The row's ``td`` cells (inside its subtree: O(row), not O(page))."""
    return X.descendants_where("elements", row, lambda e: X.is_tag(e, "td"))


def _table_day_entries(table: Column) -> Column:
    """D1 rows of one table: (day, hours) for rows with ≥ 2 cells whose first
    cell names a day."""
    def entry(row):
        cells = _row_cells(row)
        day = js_trim(_txt(_first(cells)))
        hrs = js_trim(_txt(F.try_element_at(cells, F.lit(2))))
        ok = ((F.size(cells) >= 2) & (day != "") & (hrs != "")
              & ((F.instr(day, "星期") > 0) | (F.instr(day, "週") > 0) | day.rlike(DAY_WORDS)))
        return F.when(ok, F.struct(day.alias("day"), hrs.alias("hours")))
    rows = X.descendants_where("elements", table, lambda e: X.is_tag(e, "tr"))
    return F.filter(F.transform(rows, entry), lambda x: x.isNotNull())


def _existing_hours() -> Column:
    """D1 over every table whose text looks like a week."""
    def weekly(t):
        text = _txt(t)
        return (((F.instr(text, "星期") > 0) & ((F.instr(text, "小時") > 0) | (F.instr(text, ":") > 0)))
                | (F.instr(text, "Monday") > 0) | (F.instr(text, "Tuesday") > 0))
    tables = F.filter("_tables", weekly)
    return H.dedupe_entries(F.flatten(F.transform(tables, _table_day_entries)))


def _panel_hours() -> Column:
    """The panel's table rows, else its list items."""
    panel = F.col("_panel")

    def table_entry(row):
        cells = _row_cells(row)
        day = js_trim(_txt(_first(cells)))
        hrs = js_trim(_txt(F.try_element_at(cells, F.lit(2))))
        clean_day = js_trim(first_only_replace(day, r"\([^)]+\)", ""))
        clean_hrs = js_trim(literal_first_replace(hrs, F.lit(COPY_HOURS), ""))
        ok = ((F.size(cells) >= 2) & (day != "") & (hrs != "") & (F.instr(day, COPY_HOURS) == 0)
              & (F.instr(hrs, COPY_HOURS) == 0) & (clean_day != "") & (clean_hrs != ""))
        return F.when(ok, F.struct(clean_day.alias("day"), clean_hrs.alias("hours")))

    def list_entry(li):
        text = js_trim(_txt(li))
        pattern = rf"^([^:：]+)[:：]{WS}*(.+)\z"
        matched = text.rlike(pattern)
        day = js_trim(F.regexp_extract(text, pattern, 1))
        hrs = js_trim(literal_first_replace(js_trim(F.regexp_extract(text, pattern, 2)), F.lit(COPY_HOURS), ""))
        day24 = F.regexp_extract(text, LIST_DAY, 1)
        is24 = (F.instr(text, "24 小時") > 0) | (F.instr(text, "24小時") > 0)
        return (F.when(F.instr(text, COPY_HOURS) > 0, F.lit(None))
                .when(matched, F.when((day != "") & (hrs != ""), F.struct(day.alias("day"), hrs.alias("hours"))))
                .when(is24 & (day24 != ""), F.struct(day24.alias("day"), F.lit(FULL_DAY_TEXT).alias("hours"))))

    rows = F.filter(F.transform(X.descendants_where("elements", panel, lambda e: X.is_tag(e, "tr")), table_entry),
                    lambda x: x.isNotNull())
    items = F.filter(F.transform(X.descendants_where("elements", panel, lambda e: X.is_tag(e, "li")), list_entry),
                     lambda x: x.isNotNull())
    return H.dedupe_entries(let(rows, lambda r: F.when(F.size(r) > 0, r).otherwise(items)))


def _fill_24h(entries: Column, button: Column) -> Column:
    """D3: a 24-hour button with 1–6 days, all of them 24-hour → add the
    missing days (Chinese names if any day key has 星期) as 24 小時營業."""
    return let(entries, lambda e: _fill_24h_bound(e, button))


def _fill_24h_bound(entries: Column, button: Column) -> Column:
    btn_text = F.coalesce(F.nullif(_txt(button), F.lit("")), X.attr(button, "aria-label"), F.lit(""))
    # fixed values: what says "all day"
    is24 = _any_contains(btn_text, ("24 小時", "24小時", "24 hours", "24h"))
    n = F.size(entries)
    all24 = F.forall(entries, lambda x: _any_contains(x["hours"], ("24 小時", "24小時", "24 hours"))
                     | (x["hours"] == "24h"))
    zh = F.exists(entries, lambda x: F.instr(x["day"], "星期") > 0)
    keys = F.transform(entries, lambda x: x["day"])

    def missing(days):
        return F.transform(F.filter(F.array(*[F.lit(d) for d in days]), lambda d: ~F.array_contains(keys, d)),
                           lambda d: F.struct(d.alias("day"), F.lit(FULL_DAY_TEXT).alias("hours")))
    filled = F.concat(entries, F.when(zh, missing(H.DAYS_ZH)).otherwise(missing(H.DAYS_EN)))
    return F.when(is24 & (n > 0) & (n < 7) & all24, filled).otherwise(entries)


def _hours_fallbacks() -> tuple[Column, Column, Column]:
    """D5, D6, D7 candidates (each NULL when nothing qualifies)."""
    els = F.col("elements")
    lists = [        # fixed values: selectors in priority order
        F.filter("_buttons", lambda b: X.attr_contains(b, "data-item-id", "hour")),
        F.filter("_buttons", lambda b: X.attr_contains(b, "data-item-id", "oh")),
        F.filter("_buttons", lambda b: X.attr_contains(b, "aria-label", "Hours")),
        F.filter("_buttons", lambda b: X.attr_contains(b, "aria-label", "hours")),
        F.filter("_buttons", lambda b: X.attr_contains(b, "aria-label", "營業時間")),
        F.filter("_buttons", lambda b: X.attr_contains(b, "aria-label", "時間")),
        X.select(els, lambda e: X.is_tag(e, "div") & X.attr_contains(e, "aria-label", "Hours")),
        X.select(els, lambda e: X.is_tag(e, "span") & X.attr_contains(e, "aria-label", "Hours")),
    ]

    def d5_value(e):
        label = X.attr(e, "aria-label")
        combined = F.concat(F.coalesce(_txt(e), F.lit("")), F.coalesce(label, F.lit("")))
        hours_text = F.coalesce(F.nullif(label, F.lit("")), F.nullif(_txt(e), F.lit("")), F.lit(""))
        return F.when(combined.rlike(TIMEISH) & (js_length(hours_text) > 5),
                      _clean_hours_text(hours_text, drop_emoji=True))
    d5 = _first(F.filter(F.transform(F.flatten(F.array(*lists)), d5_value), lambda v: v.isNotNull()))

    def d6_match(e):
        # ≥ 1,500 UTF-8 bytes means ≥ 500 UTF-16 units: reject before decoding
        small = (e["t1"] - e["t0"]) < 1500
        text = _txt(e)
        return small & (~_any_contains(text, FACILITY_WORDS) & text.rlike(AMPM_TIME) & (js_length(text) < 500))
    d6 = _clean_hours_text(_txt(let(F.filter("_bds", d6_match), lambda m: F.coalesce(
        _first(F.filter(m, lambda e: _any_contains(_txt(e), MAIN_HOURS_WORDS))), _first(m)))))

    def d7_match(e):
        # the words are anchored: compare the element's first bytes, decode nothing
        parent = X.parent_of(els, e)
        starts = F.lit(False)
        for word in STATUS_WORDS:
            raw = word.encode()
            starts = starts | ((e["t1"] - e["t0"] >= len(raw))
                               & (F.substring(F.col("doc_bytes"), e["t0"] + 1, F.lit(len(raw))) == F.lit(bytearray(raw))))
        return starts & parent.isNotNull() & _any_contains(_txt(parent), ("⋅", "·"))
    hit = _first(F.filter("_sds", d7_match))
    d7 = _clean_hours_text(_txt(X.parent_of(els, hit)))
    return d5, d6, d7


def _korea_detail(a: Column) -> Column:
    postal = F.regexp_extract(a, r"(?<![0-9A-Za-z_])([0-9]{5})(?![0-9A-Za-z_])", 1)
    cleaned = js_trim(first_only_replace(first_only_replace(literal_first_replace(a, postal, ""), f",{WS}*,", ","),
                                         f"^{WS}*,", ""))
    return F.when((postal != "") & ~a.startswith(postal), F.concat(postal, F.lit(" "), cleaned)).otherwise(a)


def _address() -> Column:
    """Labelled address button; label prefix removed; country rules."""
    btn = X.first_match(        # fixed values: selectors in priority order
        F.filter("_buttons", lambda b: X.attr_equals(b, "data-item-id", "address")),
        F.filter("_buttons", lambda b: X.attr_contains(b, "aria-label", "Address")),
        F.filter("_buttons", lambda b: X.attr_contains(b, "aria-label", "address")),
        F.filter("_buttons", lambda b: X.attr_contains(b, "aria-label", "地址")))
    label = X.attr(btn, "aria-label")
    text = _txt(btn)
    raw = (F.when(F.coalesce(label, F.lit("")) != "", js_trim(F.regexp_replace(label, ADDRESS_LABEL, "")))
           .when(F.coalesce(text, F.lit("")) != "", js_trim(text)))

    def shape(a: Column) -> Column:
        taiwan = _any_contains(a, ("Taiwan", "台灣"))
        japan = _any_contains(a, ("Japan", "日本"))
        korea = _any_contains(a, ("Korea", "대한민국"))
        by_country = (F.when(taiwan, a)
                      .when(japan, first_only_replace(a, "〒?([0-9]{3})-?([0-9]{4})", "〒$1-$2"))
                      .when(korea, _korea_detail(a))
                      .otherwise(a))
        tidy = F.regexp_replace(by_country, f",{WS}*,", ",")
        tidy = F.regexp_replace(tidy, f"^{WS}*,", "")
        tidy = F.regexp_replace(tidy, f",{WS}*\\z", "")
        return js_trim(tidy)
    return F.when(F.coalesce(raw, F.lit("")) != "", let(js_trim(collapse_ws(raw)), shape))


def _phone() -> Column:
    """Digits, ``+ ( ) -`` and whitespace of the phone button's label."""
    btn = X.first_match(F.filter("_buttons", lambda b: X.attr_contains(b, "aria-label", "Phone")),
                        F.filter("_buttons", lambda b: X.attr_contains(b, "aria-label", "phone")),
                        F.filter("_buttons", lambda b: X.attr_contains(b, "aria-label", "電話")))
    label = X.attr(btn, "aria-label")
    return F.when(label.isNotNull(), js_trim(F.regexp_replace(label, rf"[^0-9+()\-{WS_BODY}]", "")))


def _website() -> Column:
    """The resolved ``href`` of the website link."""
    a = X.first_match(F.filter("_anchors", lambda b: X.attr_contains(b, "aria-label", "Website")),
                      F.filter("_anchors", lambda b: X.attr_contains(b, "aria-label", "website")),
                      F.filter("_anchors", lambda b: X.attr_contains(b, "aria-label", "網站")))
    href = X.attr(a, "href")
    return F.when(a.isNotNull(), F.when(href.isNotNull(), resolve_url(href, F.col("url"))).otherwise(F.lit("")))


def _uniform_level(s: Column) -> Column:
    return s.rlike(r"^(\$+|·+)\z") & (F.length(s) <= 4)


def _price() -> Column:
    """Six stages, first hit wins; ``·`` means ``$``."""
    els = F.col("elements")
    # 1. labelled price-level elements
    labelled = [F.filter(f"_{tag}s" if tag == "button" else "_spans",
                         (lambda w: lambda e: X.attr_contains(e, "aria-label", w))(word))
                for tag, word in PRICE_LABELS]
    labelled.append(X.select(els, lambda e: X.attr_contains(e, "data-attrid", "price_level")))

    def stage1(e):
        combined = F.concat(js_trim(_txt(e)), F.lit(" "), F.coalesce(X.attr(e, "aria-label"), F.lit("")))
        level = F.regexp_extract(combined, rf"(?:^|{WS})([$·]{{1,4}})(?:{WS}|\z)", 1)
        return F.when((level != "") & _uniform_level(level), F.replace(level, F.lit("·"), F.lit("$")))
    s1 = _first(F.filter(F.transform(F.flatten(F.array(*labelled)), stage1), lambda v: v.isNotNull()))

    # 2. bare uniform symbol span with price context and no digit nearby
    def stage2(sp):
        text = js_trim(_txt(sp))
        ctx = F.lower(F.coalesce(_txt(X.parent_of(els, sp)), F.lit("")))
        in_labelled_button = F.exists("_buttons", lambda b: X.has_attr(b, "aria-label") & (b["idx"] < sp["idx"])
                                      & (sp["idx"] <= b["last"]))
        context = (_any_contains(ctx, ("price", "價", "level", "級"))
                   | (F.coalesce(X.attr(sp, "aria-label"), F.lit("")) != "") | in_labelled_button)
        return F.when(_uniform_level(text) & ~ctx.rlike("[0-9]") & context, F.replace(text, F.lit("·"), F.lit("$")))
    s2 = _first(F.filter(F.transform("_spans", stage2), lambda v: v.isNotNull()))

    # 3. buttons with an aria-label: price symbols or words in the label, or
    #    a symbol-only button text
    def stage3(b):
        label = F.coalesce(X.attr(b, "aria-label"), F.lit(""))
        text = js_trim(_txt(b))
        has_price = F.instr(F.lower(label), "price") > 0
        symbols = F.regexp_extract(label, "[$·]{1,4}", 0)
        word = (F.when(label.rlike("(?i)very expensive"), F.lit("$$$$"))
                .when(label.rlike("(?i)expensive"), F.lit("$$$"))
                .when(label.rlike("(?i)moderate"), F.lit("$$")).otherwise(F.lit("$")))
        return (F.when(has_price & (symbols != ""), F.replace(symbols, F.lit("·"), F.lit("$")))
                .when(has_price & label.rlike("(?i)expensive|moderate|inexpensive"), word)
                .when(text.rlike(r"^[$·]{1,4}\z"), F.replace(text, F.lit("·"), F.lit("$"))))
    s3 = _first(F.filter(F.transform(F.filter("_buttons", lambda b: X.has_attr(b, "aria-label")), stage3),
                         lambda v: v.isNotNull()))

    # 4. review summary
    review = _first(X.select(els, lambda e: X.attr_contains(e, "data-attrid", "review")))
    s4 = F.nullif(F.regexp_extract(F.coalesce(_txt(review), F.lit("")), r"[$]{1,4}", 0), F.lit(""))

    # 5. first text node without digits/dots/commas that contains "$"
    def node_text(n):
        return X.text_range(n["t0"], n["t1"])
    xml_space = "[ \t\n\r]+"
    first_node = _first(F.filter("text_nodes", lambda n: (F.instr(node_text(n), "$") > 0)
                                 & ~js_trim(F.regexp_replace(node_text(n), xml_space, " ")).rlike("[0-9.,]")))
    t5 = js_trim(node_text(first_node))
    s5 = F.when(t5.rlike(r"^[$]{1,4}\z"), t5)

    # 6. page-wide words
    body_text = F.lower(F.coalesce(_txt(_first("_body")), X.page_text_of()))
    s6 = F.lit(None).cast("string")
    for level, words in reversed(PRICE_WORDS):
        s6 = F.when(_any_contains(body_text, words), F.lit(level)).otherwise(s6)
    return F.coalesce(s1, s2, s3, s4, s5, s6)


def _category() -> Column:
    """Category button text, else a star-class span."""
    btn = _first(F.filter("_buttons", lambda b: X.attr_contains(b, "jsaction", "category")))
    text = js_trim(_txt(btn))
    strip = rf"^[·{WS_BODY}•]+"
    from_button = F.when((F.coalesce(text, F.lit("")) != "") & (js_length(text) < 50) & (F.instr(text, "選取日期") == 0),
                         js_trim(F.regexp_replace(text, strip, "")))
    star = _first(F.filter(F.transform("_spans", lambda s: js_trim(_txt(s))),
                           lambda t: (t != "") & t.rlike(STAR_CLASS) & (js_length(t) < 20)))
    return F.coalesce(F.nullif(from_button, F.lit("")), js_trim(F.regexp_replace(star, strip, "")))


@functools.lru_cache(maxsize=1)
def _weekly_expr() -> Column:
    """D1 → D2/D3: the weekly entries in a struct ``w`` (bound once)."""
    hbtn, panel = F.col("_hbtn"), F.col("_panel")

    def weekly_of(d1: Column) -> Column:
        d2 = F.when((F.size(d1) < 7) & hbtn.isNotNull() & panel.isNotNull(), _fill_24h(_panel_hours(), hbtn))
        return let(d2, lambda d2v: (F.when(F.size(d1) >= 7, d1)
                                    .when(hbtn.isNotNull() & panel.isNotNull(), F.when(F.size(d2v) > 0, d2v))
                                    .when(F.size(d1) > 0, d1)))
    return let(_existing_hours(), lambda d1: F.struct(weekly_of(d1).alias("w")))


@functools.lru_cache(maxsize=1)
def _hours_exprs() -> tuple[Column, ...]:
    """D4 → D5 → D6 → D7 on the weekly entries ``_weekly`` as staged columns.
    Each stage binds the previous stage's struct once (``let``), so a filter
    pushed through these projections inlines one copy per stage, not a
    multiplied tree, and each analysed expression stays shallow.  Leaves
    ``_hx`` = ``struct(hours)``."""
    d5, d6, d7 = _hours_fallbacks()
    return (
        let(F.col("_weekly"), lambda x: F.struct(F.when(F.size(x["w"]) > 0, H.hours_list(x["w"])).alias("h4"))),
        let(F.col("_hx"), lambda x: F.struct(
        x["h4"].alias("h4"), F.when(x["h4"].isNull(), d5).alias("h5"))),
        let(F.col("_hx"), lambda x: F.struct(
        x["h4"].alias("h4"), x["h5"].alias("h5"),
        F.when((size0(x["h4"]) == 0) & x["h5"].isNull(), d6).alias("h6"))),
        let(F.col("_hx"), lambda x: F.struct(
        x["h4"].alias("h4"), x["h5"].alias("h5"), x["h6"].alias("h6"),
        F.when((size0(x["h4"]) == 0) & x["h5"].isNull() & x["h6"].isNull(), d7)
        .alias("h7"))),
        let(F.col("_hx"), lambda x: F.struct(
        (F.when(F.size(x["h4"]) > 0, x["h4"])
         .when(x["h5"].isNotNull(), F.array(x["h5"]))
         .when(x["h6"].isNotNull(), F.array(x["h6"]))
         .when(x["h7"].isNotNull(), F.array(x["h7"]))
         .otherwise(x["h4"])).alias("hours"))),
    )


def _with_hours(st: DataFrame) -> DataFrame:
    """Apply the staged hours columns: ``_weekly`` (D1–D3) and ``_hx``.
    The weekly entries are a column of their own, so a query that reads only
    them does not run the fallbacks of the hours text."""
    st = st.withColumn("_weekly", _weekly_expr())
    for expr in _hours_exprs():
        st = st.withColumn("_hx", expr)
    return st


@functools.lru_cache(maxsize=1)
def _field_exprs() -> tuple[Column, ...]:
    return (_address().alias("address"), F.nullif(_phone(), F.lit("")).alias("phone"),
            F.nullif(_website(), F.lit("")).alias("website"),
            F.col("_hx.hours").alias("hours"), H.hours_map(F.col("_weekly.w")).alias("hoursDetail"),
            F.col("_weekly.w").alias("hours_entries"),
            _price().alias("priceLevel"), _category().alias("businessType"))


def detail_fields(page_elements: DataFrame, with_error: bool = False) -> DataFrame:
    """D1–D12 per captured detail page (extra page columns are carried, with
    ``with_error`` also ``parse_error``).  The rule expressions are built once
    per process and reused."""
    left_out = ("doc_bytes", "elements", "text_nodes") + (() if with_error else ("parse_error",))
    extra = [c for c in page_elements.columns if c not in left_out]
    st = _with_hours(_candidates(page_elements))
    return st.select(*extra, *_field_exprs())
