"""C1–C15 on literal tables (expected values from the reference's unit tests
and from reading its rules; see FIXTURES.md §4)."""

import pytest
from pyspark.sql import functions as F

from placeweave.functions import text as T


def run(spark, fn, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_clean_unicode(spark):
    got = run(spark, T.clean_unicode, ["a\nb", "  x　 y ", "a​b", None, "ok￵", "   "])
    assert got == ["ab", "x y", "ab", "", "ok", ""]


def test_standard_type(spark):
    got = run(spark, T.standard_type, ["4.6(1,636)", "1,234", " Coffee shop ", None, "4.6 (2", "Cafe 24"])
    assert got == ["", "", "Coffee shop", "", "", "Cafe 24"]


def test_standard_price(spark):
    got = run(spark, T.standard_price, ["¥¥", "$200-400", "Inexpensive", "Moderate", "cheap", "free", None, "€€ x $"])
    assert got == ["¥¥", "$", "$$$$", "$$", "$", "", "", "€€"]


def test_standard_hours(spark):
    got = run(spark, T.standard_hours, [
        "Monday: 07:00–22:00,", "星期一、24 小時營業, 複製營業時間", "休息日休息日", "9-5", None,
        "Mon 9-5 See more hours", "Tue 9-5 · See more"])
    assert got == ["Monday: 07:00–22:00", "星期一: 24 小時營業", "", "", "", "Mon 9-5", "Tue 9-5"]


def test_standard_address(spark):
    got = run(spark, T.standard_address, [
        "1 Main St ⋅ Closes 9 PM", "〒1000001 Tokyo, Japan", "1000001 Tokyo, Japan",
        "Jung-gu, Seoul, South Korea, 04524", "04524 Jung-gu, Seoul, South Korea", "abc", None,
        "12345 Long Street Name Here, Seoul, Korea, 99999"])
    assert got == ["1 Main St", "〒100-0001 Tokyo, Japan", "1000001 Tokyo, Japan",
                   "04524 Jung-gu, Seoul, South Korea,", "04524 Jung-gu, Seoul, South Korea", "", "",
                   "12345 Long Street Name Here, Seoul, Korea, 99999"]


def test_standard_name(spark):
    assert run(spark, T.standard_name, ["  星巴克  咖啡  ", "Café@123", None]) == ["星巴克 咖啡", "Café@123", ""]


def test_standard_phone(spark):
    vals = ["02-2345-6789", "(02) 2345-6789", "+886 2 2345 6789", "0912-345-678", "200-400", "abc",
            "0912345678", None]
    assert run(spark, T.standard_phone, vals) == [
        "+886 2 2345 6789", "(02) 2345-6789", "+886 2 2345 6789", "+886 912 345 678", "", "",
        "+886 912345678", ""]
    assert run(spark, lambda c: T.standard_phone(c, taiwan_brackets=True), ["(02) 2345-6789"]) == [
        "+886 2 2345 6789"]


def test_compact_address(spark):
    got = run(spark, T.compact_address, ["  台北市  信義區  信義路  ", "4.5(200)", "4.5 (2,000)", None])
    assert got == ["台北市信義區信義路", "", "", ""]


def test_standard_website(spark):
    got = run(spark, T.standard_website, [
        "www.example.com", "https://example.com?utm_source=google", "facebook.com/page123",
        "www.facebook.com/x", None, "http://a.b/c#frag"])
    assert got == ["https://www.example.com", "https://example.com", "https://www.facebook.com/page123",
                   "https://www.www.facebook.com/x", "", "http://a.b/c#frag"]


def test_is_email(spark):
    got = run(spark, T.is_email, ["test@example.com", "user.name@company.co.tw", "notanemail",
                                  "@example.com", "test@", None])
    assert got == [True, True, False, False, False, False]


def test_extract_emails(spark):
    got = run(spark, T.extract_emails, [
        "Contact us at info@example.com or sales@example.com",
        "Email: test@example.com, contact: test@example.com", "No email here", None])
    assert got == [["info@example.com", "sales@example.com"], ["test@example.com"], [], []]


def test_standard_rating(spark):
    assert run(spark, T.standard_rating, ["4.567", "4.5", "5.5", "-1", "abc", None, "4.25"]) == [
        4.6, 4.5, 5.0, 0.0, 0.0, 0.0, 4.3]
    assert run(spark, T.standard_rating, [4.567, float("nan"), None], "double") == [4.6, 0.0, 0.0]


def test_standard_reviews(spark):
    assert run(spark, T.standard_reviews, ["1,234", "500", "(200)", "abc", None, "1.5K"]) == [
        1234, 500, 200, 0, 0, 1]


def test_strict_type(spark):
    assert run(spark, T.strict_type, ["  餐廳  ", "Coffee Shop", "4.5(200)", "$$$", None]) == [
        "餐廳", "Coffee Shop", "", "", ""]


@pytest.mark.parametrize("value", ["a  b", " x ", "　y　"])
def test_idempotent(spark, value):
    once = run(spark, T.clean_unicode, [value])[0]
    assert run(spark, T.clean_unicode, [once])[0] == once
    once = run(spark, T.standard_name, [value])[0]
    assert run(spark, T.standard_name, [once])[0] == once


def test_traps(spark):
    from placeweave.operators.hours import hours_map
    from placeweave.sources.requests import uri_component, url_label_expr

    df = spark.createDataFrame([("a+b c!~*'()é/?",)], "v string")
    r = df.select(uri_component(F.col("v")).alias("enc"),
                  url_label_expr(F.lit("https://x/maps/search/a+b%20c/@1")).alias("label"),
                  T.first_only_replace(F.lit("x12-34 y56-78"), "([0-9]+)-([0-9]+)", "$2:$1").alias("first"),
                  T.standard_type(F.lit("1,234\n")).alias("t9"),
                  hours_map(F.array(F.struct(F.lit("Mon").alias("day"), F.lit("9").alias("hours")),
                                    F.struct(F.lit("Mon").alias("day"), F.lit("10").alias("hours")))).alias("m"))
    row = r.first()
    assert row.enc == "a%2Bb%20c!~*'()%C3%A9%2F%3F"           # T4: encodeURIComponent
    assert row.label == "a+b c"                                # T4: '+' kept, %20 decoded
    assert row.first == "x34:12 y56-78"                        # T7: first hit only, groups shifted
    assert row.t9 == ""                                        # JS whitespace includes the newline
    assert dict(row.m) == {"Mon": "10"}                        # T10: repeated key → last value, no error
