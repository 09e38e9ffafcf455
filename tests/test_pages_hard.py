"""Pages that break naive extraction: everything is kept, nothing dies, time is
linear."""

import time

import pytest
from pyspark.sql import functions as F

from placeweave.operators import elements as X
from placeweave.operators import emails as E
from placeweave.operators import pages as P

PROBES = [
    ("<body><script>var t='</body>';</script> late@x.tw</body>", ["late@x.tw"]),
    ("<body>a@b.tw</body><p>after@x.tw</p>", ["a@b.tw", "after@x.tw"]),
    ("<body>info&#64;shop.tw and x&#x40;y.tw, z&commat;q.tw</body>", ["info@shop.tw", "x@y.tw", "z@q.tw"]),
    ('<body><a href="mailto:own&#101;r@s.tw">m</a></body>', ["owner@s.tw"]),
    ("<script>'<body>'</script><body>in@s.tw<!-- out@s.tw", ["in@s.tw"]),
    ("<body>x@s.tw<style>hid@s.tw", ["x@s.tw"]),
    ("<body>one@s.tw <a href='mailto:two@s.tw", ["one@s.tw"]),
]


def test_no_address_is_lost(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(PROBES)], "i int, html string")
    got = [r[0] for r in df.orderBy("i").select(E.page_emails_expr("html")).collect()]
    assert got == [e for _, e in PROBES]


def test_character_references(spark):
    table = {"a &amp; b": "a & b", "&amp;lt;": "&lt;", "&lt;p&gt;": "<p>", "&#20013;&#x6587;": "\u4e2d\u6587", "&#128512;": "\U0001F600",
             "&eacute;t&eacute;": "\u00e9t\u00e9", "&nbsp;": "\u00a0", "&unknown; &": "&unknown; &", "&#0;&#xD800;&#9999999;": "\ufffd" * 3,
             "x&#64y": "x@y", "none": "none", "": ""}
    df = spark.createDataFrame(list(enumerate(table)), "i int, v string")
    assert [r[0] for r in df.orderBy("i").select(P.decode_entities("v")).collect()] == list(table.values())


@pytest.mark.parametrize("unit", ["<!--", "<script>", "<style ", "<a ", "<p ", "<a href='x", "<body ", "&#", "&amp"])
def test_unclosed_openers_take_linear_time(spark, unit):
    df = spark.createDataFrame([(1, "u", "<body>x " + unit * (1_000_000 // len(unit)))], "page_id long, url string, html string")
    start = time.time()
    df.select(E.page_emails_expr("html")).collect()
    assert time.time() - start < 10


def test_marked_sections_are_comments(spark):
    pages = ["<p>a</p><![foo[x]]><p>b</p>", "<p>a<![CDATA[x]]>b</p>", "<![if x><p>c</p>", "<!", "<![", "<?x"]
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    rows = X.page_elements(df).orderBy("page_id").select("parse_error", F.size("elements")).collect()
    assert [r[0] for r in rows] == [None] * 6 and [r[1] for r in rows][:3] == [5, 4, 4]


def test_a_page_that_fails_is_reported(spark, monkeypatch):
    def refuse(self, data):
        raise ValueError("no")
    monkeypatch.setattr(X.Tree, "feed", refuse)
    assert X.flatten_page("<p>a") == (b"", [], [], "ValueError: no")
