"""Property tests on random Unicode text (each example is a list of strings run
as one Spark job), and tables of inputs with the results they must give."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placeweave.functions import text as T
from placeweave.operators.placeids import js_string_hash

# JavaScript's whitespace set (\s and trim).
JS_WS = ("\t\n\x0b\x0c\r \xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
         + "\u2028\u2029\u202f\u205f\u3000\ufeff")
JUNK = re.compile("[\x00-\x1f\x7f-\x9f\ue000-\uf8ff\ufff0-\uffff\u200b-\u200d\ufeff]")
ALPHABET = st.sampled_from(list("ab Z09.,") + list(JS_WS)
                           + ["\x00", "\x85", "\u200b", "\ue000", "\U0001F600", "\u53f0", "\u00e9"])
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=12), min_size=1, max_size=40)


def js_trim_model(s):
    return s.strip(JS_WS)


def clean_model(s):
    s = JUNK.sub("", s)
    s = js_trim_model(s)
    return re.sub(f"[{re.escape(JS_WS)}]+", " ", s)


def _eval(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in df.orderBy("i").select("i", *exprs).collect()]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=TEXTS)
def test_text_rules_match_models(spark, values):
    v = F.col("v")
    rows = _eval(spark, values, T.clean_unicode(v), T.clean_unicode(T.clean_unicode(v)), T.js_trim(v),
                 T.js_length(v), T.standard_name(v), T.standard_name(T.standard_name(v)))
    for s, (clean, clean2, trim, length, name, name2) in zip(values, rows):
        assert clean == clean_model(s) and clean2 == clean           # C1 and idempotence
        assert trim == js_trim_model(s)
        assert length == len(s.encode("utf-16-le")) // 2
        assert name2 == name                                          # C6 idempotent


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(nums=st.lists(st.floats(min_value=-10, max_value=10, allow_nan=False), min_size=1, max_size=30))
def test_rating_idempotent_and_bounded(spark, nums):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(nums)], "i int, x double")
    rows = df.orderBy("i").select(T.standard_rating("x").alias("r")) \
        .select("r", T.standard_rating("r").alias("r2")).collect()
    for (r, r2), x in zip(rows, nums):
        assert 0 <= r <= 5 and r2 == r                               # C12 idempotent, clamped
        assert abs(r - min(5, max(0, x))) <= 0.05 + 1e-9


TAGS = ["div", "p", "span", "a", "b", "li", "ul", "td", "tr", "table", "br", "img", "script", "button"]
TOKEN = st.one_of(
    st.sampled_from(TAGS).map(lambda t: f"<{t}>"),
    st.sampled_from(TAGS).map(lambda t: f"</{t}>"),
    st.sampled_from(TAGS).map(lambda t: f'<{t} class="k" data-pid=x>'),
    st.text(alphabet=st.sampled_from(list("ab é&;<>台 ")), min_size=1, max_size=6),
    st.just("<!-- c -->"), st.just("&amp;"), st.just("<br/>"))


@settings(max_examples=300, deadline=None)
@given(st.lists(TOKEN, max_size=40))
def test_element_table_invariants(tokens):
    from placeweave.operators.elements import flatten_html_nodes

    text, rows, nodes = flatten_html_nodes("".join(tokens))
    text.decode("utf-8")                                          # valid UTF-8 throughout
    for i, (idx, parent, depth, last, tag, attrs, t0, t1) in enumerate(rows):
        assert idx == i and idx <= last < len(rows)
        assert 0 <= t0 <= t1 <= len(text)
        text[t0:t1].decode("utf-8")                               # ranges fall on character boundaries
        if parent >= 0:
            p = rows[parent]
            assert parent < idx <= p[3]                           # inside the parent's subtree interval
            assert p[6] <= t0 and t1 <= p[7]                      # text nested in the parent's text
            assert depth == p[2] + 1
        else:
            assert depth == 0
        for j in range(idx + 1, len(rows)):                       # subtree == (idx, last]
            k = rows[j][1]
            while k > idx:
                k = rows[k][1]
            assert (k == idx) == (j <= last)
    for a, b in nodes:
        assert 0 <= a < b <= len(text)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(TOKEN, max_size=30), min_size=1, max_size=12))
def test_navigation_helpers_match_brute_force(spark, pages):
    from placeweave.operators import elements as X

    htmls = ["".join(p) for p in pages]
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    els = F.col("elements")
    out = X.page_elements(df).select("page_id", F.transform(els, lambda e: F.struct(
        F.size(X.subtree(els, e)).alias("n_sub"),
        X.first_descendant_where(els, e, lambda d: d["tag"] == "span")["idx"].alias("first_span"),
        X.closest_where(els, e, lambda a: a["tag"] == "div")["idx"].alias("closest_div"),
        X.parent_of(els, e)["idx"].alias("parent"))).alias("nav")).orderBy("page_id").collect()
    for r, h in zip(out, htmls):
        _, rows, _ = X.flatten_html_nodes(h)
        for row, nav in zip(rows, r.nav):
            idx, parent, last = row[0], row[1], row[3]
            spans = [j for j in range(idx + 1, last + 1) if rows[j][4] == "span"]
            k = idx
            while k >= 0 and rows[k][4] != "div":
                k = rows[k][1]
            assert nav.n_sub == last - idx
            assert nav.first_span == (spans[0] if spans else None)
            assert nav.closest_div == (k if k >= 0 else None)
            assert nav.parent == (parent if parent >= 0 else None)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "d", "e"]), max_size=25), min_size=1, max_size=10))
def test_w1_first_wins_matches_model(spark, pages):
    from placeweave.operators.listing import first_wins

    rows = [(i, [(ident, pos) for pos, ident in enumerate(ids)]) for i, ids in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id int, l array<struct<placeId:string,pos:int>>")
    got = {r.page_id: [(x.placeId, x.pos) for x in r.k] for r in df.select("page_id", first_wins(F.col("l")).alias("k")).collect()}
    for i, ids in enumerate(pages):
        seen, want = set(), []
        for pos, ident in enumerate(ids):
            if ident not in seen:
                seen.add(ident)
                want.append((ident, pos))
        assert got[i] == want


def test_published_31_hash_values(spark):
    known = {"": 0, "a": 97, "hello": 99162322, "Hello": 69609650, "polygenelubricants": -2 ** 31}
    rows = _eval(spark, list(known), js_string_hash(F.col("v")))
    assert [r[0] for r in rows] == list(known.values())


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.text(alphabet=ALPHABET, min_size=1, max_size=10), min_size=2, max_size=20))
def test_hash_of_a_concatenation(spark, values):
    """The hash of two texts follows from the hashes of both."""
    pairs = list(zip(values, values[1:]))
    single = [r[0] for r in _eval(spark, values, js_string_hash(F.col("v")))]
    both = [r[0] for r in _eval(spark, [a + b for a, b in pairs], js_string_hash(F.col("v")))]
    for (_, b), x, y, h in zip(pairs, single, single[1:], both):
        units = len(b.encode("utf-16-le")) // 2
        assert (h - x * 31 ** units - y) % 2 ** 32 == 0 and -2 ** 31 <= h < 2 ** 31


def check_table(spark, rule, table):
    rows = _eval(spark, [k for k, _ in table], rule(F.col("v")))
    assert [r[0] for r in rows] == [v for _, v in table]


def test_c5_addresses(spark):
    check_table(spark, T.standard_address, [
        ("12 Main St, Taipei", "12 Main St, Taipei"), ("  12  Main\u3000St ", "12 Main St"), ("abcd", ""), (None, ""), ("", ""),
        ("5 Long Road Opens 9 AM", "5 Long Road"), ("5 Long Road closes soon", "5 Long Road"), ("台北市信義區 ⋅ 營業中", "台北市信義區"),
        ("日本 〒1000001 東京", "日本 〒100-0001 東京"), ("Japan 〒100-0001 Tokyo", "Japan 〒100-0001 Tokyo"), ("〒1000001 Tokyo", "〒1000001 Tokyo"),
        ("110 Sejong-daero, Jung-gu, Seoul, South Korea, 04524", "04524 110 Sejong-daero, Jung-gu, Seoul, South Korea,"),
        ("04524 Seoul, South Korea", "04524 Seoul, South Korea"), ("04524, Jung-gu, Seoul, Korea x", "04524, Jung-gu, Seoul, Korea x")])


def test_c4_hours(spark):
    check_table(spark, T.standard_hours, [
        ("09:00–17:00", "09:00–17:00"), ("9 AM – 5 PM, Copy open hours", "9 AM – 5 PM"), ("9 AM – 5 PM See more hours", "9 AM – 5 PM"),
        ("9 AM – 5 PM · See more", "9 AM – 5 PM"), ("9 AM – 5 PM, copy hours", "9 AM – 5 PM"), ("星期一、24 小時營業", "星期一: 24 小時營業"), ("週三，24小時營業", "週三: 24小時營業"),
        ("星期一、24 小時營業 x", "星期一: 24 小時營業 x"), ("休息", ""), ("Mon", ""), (None, ""), ("See more hoursX 10", "See more hoursX 10")])


def test_c7_phones(spark):
    check_table(spark, T.standard_phone, [
        ("02-2345-6789", "+886 2 2345 6789"), ("0912-345-678", "+886 912 345 678"), ("0912 345 678", "+886 912 345 678"),
        ("Tel: 02-2345-6789", "+886 2 2345 6789"), ("+1 (415) 555-0100", "+1 (415) 555-0100"), ("200-400", ""), ("(02) 2345-6789", "(02) 2345-6789"),
        ("call us", ""), (None, ""), ("", "")])


PHONE_TOKENS = st.sampled_from(["0", "09", "9", "12", "345", "678", "2345", "6789", "-", " ", "(", ")", "+886", "a",
                                "\u3000", "\n", "200-400", "Tel:"])


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PHONE_TOKENS, max_size=8).map("".join), min_size=1, max_size=40))
def test_c7_alphabet_and_digits(spark, values):
    from placeweave.operators.phones import first_phone_expr

    rows = _eval(spark, values, T.standard_phone(F.col("v")), first_phone_expr(F.col("v")))
    for s, (phone, found) in zip(values, rows):
        assert re.fullmatch(f"[0-9+()\\-{re.escape(JS_WS)}]*", phone)
        digits, kept = re.sub("[^0-9]", "", s), re.sub("[^0-9]", "", phone)
        assert phone == "" or kept == digits or kept == "886" + digits[1:]
        assert js_trim_model(phone) == phone
        if found is not None:                                            # L11 finds a stretch of the text
            assert found in s and js_trim_model(found) == found and re.search("[0-9]{3}", found)


def test_l11_first_pattern_wins(spark):
    from placeweave.operators.phones import first_phone_expr

    check_table(spark, first_phone_expr, [
        ("call 02-2345-6789 or +886 2 2345 6789", "+886 2 2345 6789"), ("x (02) 2345-6789 y", "(02) 2345-6789"),
        ("at 02 2345 6789.", "02 2345 6789"), ("+1 415 555 0100", "+1 415 555 0100"), ("mobile 0912-345-678", "0912-345-678"),
        ("200-400 only", None), ("no phone", None)])


def test_l1_to_l4_place_links(spark):
    from placeweave.operators.placeids import coordinate_of, place_id_of

    table = [("https://m.test/maps/place/Cafe/ChIJab?hl=en", None, "ChIJab", None, None),
             ("https://m.test/maps/place/Cafe/data=!1sChIJcd!8m2", None, "ChIJcd", None, None),
             ("https://m.test/maps/place/Cafe/data=!4m2&1sChIJef&x", None, "ChIJef", None, None),
             ("https://m.test/maps/place/Cafe/data=!19sChIJgh?x", None, "ChIJgh", None, None),
             ("https://m.test/maps/place/Cafe/data=!1s0x1a:0x2b", "ChIJattr", "ChIJattr", None, None),
             ("https://m.test/maps/place/Cafe/data=!1s0x1a:0x2b!3d25.03!4d121.5", "xyz", "hex_0x1a:0x2b", 25.03, 121.5),
             ("https://m.test/maps/place/Cafe/", "", "fallback_7_6", None, None),
             ("https://m.test/maps/place/Cafe/x!3d-1.5x!4d.5e1", None, "fallback_7_7", -1.5, 5.0),
             ("https://m.test/maps/place/Cafe/x!3dx!4d1", None, "fallback_7_8", None, 1.0)]
    df = spark.createDataFrame([(i, 7, h, d) for i, (h, d, *_) in enumerate(table)], "i int, page_id long, href string, data_pid string")
    none = F.lit(None).cast("string")
    got = df.orderBy("i").select(
        place_id_of(F.col("href"), F.col("data_pid"), none, none, none, none, none, F.col("page_id"), F.col("i")),
        coordinate_of(F.col("href"), 1), coordinate_of(F.col("href"), 2)).collect()
    assert [tuple(r) for r in got] == [tuple(t[2:]) for t in table]
