"""Registered queries that put literal cases to the text rules (C1–C14, L11,
X2, X3, E2–E6): the customers' keys choose a case and stand in its text, the
DuckDB twins state each case's result as it was derived by hand.  They share
no pattern with the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions import text as T
from placeweave.operators import emails as E
from placeweave.operators import pages as P
from placeweave.operators.phones import first_phone_expr
from placeweave.plans.q_captured import _pick, _text, key
from placeweave.plans.registry import register
from placeweave.sources import requests as RQ
from placeweave.sources.tables import dealt, load

# Inputs and results ("{k}" is the key), per rule.
CASES: dict[str, tuple] = {
    "clean": (T.clean_unicode, ("a\nb{k}", "ab{k}"), (" x　 {k} ", "x {k}"), ("a​b", "ab"), ("ok￿5", "ok5"), ("   ", "")),
    "type": (T.standard_type, ("4.6(1,636)", ""), (" Coffee shop ", "Coffee shop"), ("4.6 (2", ""), ("Cafe {k}", "Cafe {k}"), ("1,234", "")),
    "price": (T.standard_price, ("¥¥", "¥¥"), ("$200-400", "$"), ("Inexpensive", "$$$$"), ("Moderate", "$$"), ("cheap", "$"), ("free", ""), ("€€ x $", "€€")),
    "hours": (T.standard_hours, ("Monday: 07:00–22:00,", "Monday: 07:00–22:00"), ("星期一、24 小時營業, 複製營業時間", "星期一: 24 小時營業"),
              ("休息日休息日", ""), ("9-5", ""), ("Mon 9-5 See more hours", "Mon 9-5"), ("Tue 9-5 · See more", "Tue 9-5")),
    "address": (T.standard_address, ("{k} Main St ⋅ Closes 9 PM", "{k} Main St"), ("〒1000001 Tokyo, Japan", "〒100-0001 Tokyo, Japan"),
                ("Jung-gu, Seoul, South Korea, 04524", "04524 Jung-gu, Seoul, South Korea,"),
                ("04524 Jung-gu, Seoul, South Korea", "04524 Jung-gu, Seoul, South Korea"), ("abc", "")),
    "name": (T.standard_name, ("  星巴克  {k} ", "星巴克 {k}"), ("Café@123", "Café@123"), (" \t ", "")),
    "phone": (T.standard_phone, ("02-2345-6789", "+886 2 2345 6789"), ("(02) 2345-6789", "(02) 2345-6789"), ("0912-345-678", "+886 912 345 678"),
              ("200-400", ""), ("abc", ""), ("0912345678", "+886 912345678")),
    "compact": (T.compact_address, ("  台北市  信義區  {k} 號 ", "台北市信義區{k}號"), ("4.5(200)", ""), ("4.5 (2,000)", "")),
    "website": (T.standard_website, ("www.shop{k}.com", "https://www.shop{k}.com"), ("https://shop{k}.com?utm_source=google", "https://shop{k}.com"),
                ("facebook.com/page{k}", "https://www.facebook.com/page{k}"), ("http://a.b/c#frag", "http://a.b/c#frag")),
    "is_email": (lambda c: T.is_email(c).cast("string"), ("test{k}@example.com", "true"), ("user.name@company.co.tw", "true"), ("notanemail", "false"),
                 ("@example.com", "false"), ("test@", "false")),
    "emails": (lambda c: F.array_join(T.extract_emails(c), ","), ("Contact us at info{k}@example.com or sales@example.com", "info{k}@example.com,sales@example.com"),
               ("Email: t{k}@example.com, contact: t{k}@example.com", "t{k}@example.com"), ("No email here", "")),
    "rating": (lambda c: T.standard_rating(c).cast("string"), ("4.567", "4.6"), ("4.5", "4.5"), ("5.5", "5.0"), ("-1", "0.0"), ("abc", "0.0"), ("4.25", "4.3")),
    "reviews": (lambda c: T.standard_reviews(c).cast("string"), ("1,234", "1234"), ("{k}", "{k}"), ("(200)", "200"), ("abc", "0"), ("1.5K", "1")),
    "strict": (T.strict_type, ("  餐廳  ", "餐廳"), ("Coffee Shop", "Coffee Shop"), ("4.5(200)", ""), ("$$$", "")),
    "first_phone": (lambda c: F.coalesce(first_phone_expr(c), F.lit("")), ("Cafe · (02) 2345-6789 · 200-400", "(02) 2345-6789"),
                    ("call 0912-345-678 now", "0912-345-678"), ("+886 2 2345 6789 or (02) 1111-2222", "+886 2 2345 6789"), ("open 24 hours", ""),
                    ("tel 02-2345-6789", "02-2345-6789")),
}


def _filled(template: str) -> Column:
    first, *rest = template.split("{k}")
    return _text(first, *[x for part in rest for x in (key(), part)])


def _literal(template: str) -> str:
    return "'" + template.replace("'", "''").replace("{k}", "' || k || '") + "'"


def _case_sql(cases) -> str:
    return f"CASE k % {len(cases)} " + " ".join(f"WHEN {i} THEN {_literal(want)}" for i, (_, want) in enumerate(cases)) + " END"


@register("rule_values", "SELECT CAST(k AS BIGINT) AS id, " + ", ".join(f"{_case_sql(cases)} AS {name}" for name, (_, *cases) in CASES.items())
          + " FROM (SELECT c_custkey AS k FROM customer)")
def rule_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1–C14 and L11 on literal cases."""
    inputs = [_pick(key() % len(cases), *[_filled(given) for given, _ in cases]).alias(name) for name, (_, *cases) in CASES.items()]
    rows = dealt(load(spark, sf_dir, "customer", "c_custkey")).select(key().cast("long").alias("id"), *inputs)
    return rows.select("id", *[rule(F.col(name)).alias(name) for name, (rule, *_) in CASES.items()])


#: Pages with their text and e-mail addresses.
PAGES = (
    ("<body><p>Hello {k}</p><script>var a='x@y.tw'</script><p>a&amp;b</p></body>", "Hello {k}\na&b", ""),
    ('<body>Mail Info{k}@Shop.TW<br>or x@y.tw <a href="mailto:Own{k}@s.tw?subject=q">m</a></body>', "Mail Info{k}@Shop.TW\nor x@y.tw m",
     "info{k}@shop.tw,x@y.tw,own{k}@s.tw"),
    ("<body><!-- hid@s.tw --><div>in{k}&#64;s.tw</div>", "in{k}@s.tw", "in{k}@s.tw"),
    ("<table><tr><td>a<td>{k}<tr><td>c</table>", "a\t{k}\nc", ""),
    ('<head><title>no@t.tw</title></head><body class="x">  two   spaces {k}  </body>', "two spaces {k}", ""),
    ("<body><style>p{}</style>one@s.tw, ONE@s.tw<ul><li>x<li>y{k}</ul></body> after", "one@s.tw, ONE@s.tw\nx\ny{k}\nafter", "one@s.tw"),
)


@register("page_rules", "SELECT CAST(k AS BIGINT) AS page_id, " + ", ".join(
    f"CASE k % {len(PAGES)} " + " ".join(f"WHEN {i} THEN {_literal(p[j])}" for i, p in enumerate(PAGES)) + f" END AS {name}"
    for j, name in ((1, "text"), (2, "emails"))) + " FROM (SELECT c_custkey AS k FROM customer)")
def page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 and E2–E4 on literal pages."""
    html = _pick(key() % len(PAGES), *[_filled(p[0]) for p in PAGES])
    rows = dealt(load(spark, sf_dir, "customer", "c_custkey")).select(key().cast("long").alias("page_id"), html.alias("html"))
    return rows.select("page_id", P.visible_text_expr("html").alias("text"), F.array_join(E.page_emails_expr("html"), ",").alias("emails"))


#: Links of a page at ``https://h{k}.test/d/x?q#f`` and where they lead.
LINKS = (
    ('<a href="/p/{k}">', "https://h{k}.test/p/{k}"), ("<A class=y HREF='rel?a=1&amp;b=2'>", "https://h{k}.test/d/rel?a=1&b=2"),
    ("<a href=//o.test/z>", "https://o.test/z"), ('<a href="?a=1">', "https://h{k}.test/d/x?a=1"), ('<a href="#g">', "https://h{k}.test/d/x?q#g"),
    ('<a href="">', "https://h{k}.test/d/x?q"), ('<a href="mailto:m{k}@s.tw">', "mailto:m{k}@s.tw"), ('<a\nhref = "HTTP://Up.test/">', "HTTP://Up.test/"),
)


@register("link_rules", " UNION ALL ".join(
    f"SELECT CAST(k AS BIGINT) AS page_id, CAST({i} AS INTEGER) AS pos, {_literal(want)} AS link_url FROM (SELECT c_custkey AS k FROM customer)"
    for i, (_, want) in enumerate(LINKS)))
def link_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3 on literal links; those in comments, scripts and without ``href``
    are none."""
    html = _text("<body><a name=n>x</a><!-- <a href='/c'> --><script>'<a href=\"/s\">'</script>", *[_filled(given) for given, _ in LINKS], "</body>")
    rows = dealt(load(spark, sf_dir, "customer", "c_custkey")).select(
        key().cast("long").alias("page_id"), _text("https://h", key(), ".test/d/x?q#f").alias("url"), html.alias("html"))
    return P.page_links(rows).select("page_id", "pos", "link_url")


#: Search texts with their encoded form, and start URLs with their label or error.
SEARCHES = (("咖啡 {k}", "%E5%92%96%E5%95%A1%20{k}", "true"), ("bar & grill {k}", "bar%20%26%20grill%20{k}", "false"),
            ("café+{k}", "caf%C3%A9%2B{k}", "true"), ("it's 100% (ok)! ~{k}", "it's%20100%25%20(ok)!%20~{k}", "false"))
START_URLS = (("https://m.test/maps/search/tea+house/@1,2?x={k}", "tea+house", ""), ("https://m.test/search/%E8%8C%B6%20{k}/", "茶 {k}", ""),
              ("https://m.test/maps/place/P{k}", "Direct URL", ""), ("https://m.test/search/%E4%ZZ{k}", "", "URI malformed"),
              ("m.test/search/x{k}", "", "Invalid URL"), ("https:// /search/x{k}", "", "Invalid URL"), ("word {k}", "", "Invalid URL"))


@register("request_rules", "SELECT CAST(k AS BIGINT) AS id, " + ", ".join(
    f"CASE k % {len(cases)} " + " ".join(f"WHEN {i} THEN {prefix}{_literal(c[j])}{suffix}" for i, c in enumerate(cases)) + f" END AS {name}"
    for cases, j, name, prefix, suffix in (
        (SEARCHES, 1, "search_url", "'https://www.google.com/maps/search/' || ", " || '?hl=zh-TW'"), (SEARCHES, 2, "non_ascii", "", ""),
        (START_URLS, 1, "label", "", ""), (START_URLS, 2, "error", "", ""))) + " FROM (SELECT c_custkey AS k FROM customer)")
def request_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2, O3 and the reasons of O4 on literal searches and start URLs."""
    rows = dealt(load(spark, sf_dir, "customer", "c_custkey")).select(
        key().cast("long").alias("id"), _pick(key() % len(SEARCHES), *[_filled(c[0]) for c in SEARCHES]).alias("query"), F.lit("zh-TW").alias("language"),
        _pick(key() % len(START_URLS), *[_filled(c[0]) for c in START_URLS]).alias("start_url"))
    error = RQ.url_error_expr("start_url")
    return RQ.with_search_url(rows).select(
        "id", "search_url", F.col("non_ascii").cast("string").alias("non_ascii"),
        F.when(error.isNull(), RQ.url_label_expr("start_url")).otherwise(F.lit("")).alias("label"), F.coalesce(error, F.lit("")).alias("error"))
