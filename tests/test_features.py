"""Runs and manifests, page bytes, shown text, blacklists, row index, areas."""

import random

import pytest
from pyspark.sql import functions as F

from placeweave.operators import emails as E
from placeweave.operators import relational as R
from placeweave.operators.visibility import shown_text
from placeweave.plans import analyses as AN
from placeweave.plans import quality as V
from placeweave.sources import pagebytes as PB
from placeweave.sources import runs


# -- O5, O6 ------------------------------------------------------------------

def test_a_repeated_run_takes_its_own_place(spark, tmp_path):
    path, ddl = str(tmp_path / "t"), "id long, v string"

    def rows(*pairs):
        return spark.createDataFrame(list(pairs), ddl).repartition(3)
    assert runs.append_run(rows((1, "a"), (2, "b")), path, "r1", {"top": F.max("id")}) == {"rows_written": 2, "top": 2}
    runs.append_run(rows((3, "c")), path, "r2")
    runs.append_run(rows((1, "a")), path, "r1", {"top": F.max("id")})               # a retry with fewer rows
    runs.write_attempt(rows((9, "z")), path, "r2")                                  # dies before its commit
    got = sorted(tuple(r) for r in runs.read_runs(spark, path, ddl).select("id", "v", "run").collect())
    assert got == [(1, "a", "r1"), (3, "c", "r2")]
    runs.append_run(rows((1, "a")).limit(0), path, "r1")                            # a retry without rows
    assert [r.id for r in runs.read_runs(spark, path, ddl).collect()] == [3]
    seen = {r.run: (r.rows_written, r.top) for r in runs.manifest(spark, path, rows_written="long", top="long").collect()}
    assert seen == {"r1": (0, None), "r2": (1, None)}
    with pytest.raises(ValueError, match="attempt"):
        runs.append_run(spark.createDataFrame([(1, "x")], "id long, Attempt string"), path, "r3")


# -- O8 ----------------------------------------------------------------------

@pytest.mark.parametrize("data,want", [
    ("台北".encode("big5"), ("¥x¥_", "windows-1252")),
    (b'<meta charset="big5">' + "台北".encode("big5"), ('<meta charset="big5">台北', "big5hkscs")),
    (b"<META content='text/html; charset = Shift_JIS'>" + "カフェ".encode("cp932"), ("<META content='text/html; charset = Shift_JIS'>カフェ", "cp932")),
    (b"<!-- <meta charset=big5> -->caf\xc3\xa9", ("<!-- <meta charset=big5> -->café", "utf-8")),
    (b"<?xml version='1.0' encoding='euc-kr'?>" + "서울".encode("euc-kr"), ("<?xml version='1.0' encoding='euc-kr'?>서울", "cp949")),
    (b"\xff\xfe" + "中".encode("utf-16-le"), ("中", "utf-16-le")),
    (b"\xef\xbb\xbf<meta charset=big5>" + "é".encode(), ("<meta charset=big5>é", "utf-8")),
    (b"<meta charset=nonsense>caf\xe9", ("<meta charset=nonsense>café", "windows-1252")),
    (b"<meta charset=utf-16>ok", ("<meta charset=utf-16>ok", "utf-8")),
    (b"<meta charset=utf-8>\xff!", ("<meta charset=utf-8>�!", "utf-8")),
    (b" " * 1024 + b"<meta charset=big5>", (" " * 1024 + "<meta charset=big5>", "utf-8")),
    (b"", ("", "utf-8")), (None, (None, None))])
def test_charsets(data, want):
    assert PB.decode_page(data) == want


def test_loose_files_in_several_encodings(spark, tmp_path):
    texts = {"a.html": ("utf-8", "台北 ü"), "sub/b.html": ("big5", "<meta charset=big5>台北"), "c.txt": ("utf-8", "no")}
    for name, (codec, text) in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode(codec))
    got = PB.read_page_files(spark, str(tmp_path), "*.html")
    assert got.columns == ["page_id", "url", "html", "charset"]
    assert {r.url.rsplit("/", 1)[1]: r.html for r in got.collect()} == {"a.html": "台北 ü", "b.html": "<meta charset=big5>台北"}
    assert PB.decode_pages(got.select(F.lit(1).alias("a.b"), F.lit(None).cast("binary").alias("content"))).select("`a.b`", "html").distinct().collect() == [(1, None)]


# -- X2 ----------------------------------------------------------------------

@pytest.mark.parametrize("html,want", [
    ("<p>a<p style='display:none'>b<p>c", "a\nc"),
    ("<div hidden>x<div>y</div></div>z", "z"),
    ("a<span style='visibility: hidden'>b<i>c</i></span>d", "ad"),
    ("a<span style='display:none-such'>b</span><span style='x-display:none'>c</span>", "abc"),
    ("<title>t</title><script>s</script>a<style>q</style><noscript>n</noscript>", "a"),
    ("<table><tr><td>1<td>2<tr hidden><td>3<tr><td>4</table>", "1\t\t2\n4"),
    ("<ul><li>a</li><li hidden>b</li><li>c</li></ul>", "a\nc"),
    ("a <b> b\n\n c</b><br>d", "a b c\nd"),
    ("<pre>a  b\n c</pre>d", "a  b\nc\nd"),
    ("<dialog>x</dialog><dialog open>y</dialog>", "y"),
    ("<p hidden>a</p><p hidden>b</p>", ""), ("", ""), (None, "")])
def test_shown_text(html, want):
    assert shown_text(html) == want


def test_hidden_addresses_are_none(spark):
    html = ("<div style='display:none'>no@a.tw</div><p>yes@a.tw</p><p>and@a.tw</p>"
            "<a hidden href='mailto:link@a.tw'>x</a><div hidden><div hidden>deep@a.tw</div></div>")
    pages = spark.createDataFrame([(1, "https://a.tw/", html), (2, "https://b.tw/", None)], "page_id long, url string, html string")
    got = {r.page_id: r.emails for r in E.shown_page_emails(pages).collect()}
    assert got[1] == ["yes@a.tw", "and@a.tw", "link@a.tw"] and not got[2]
    business = spark.createDataFrame([("https://a.tw/",), ("https://c.tw/",)], "website string")
    mails = {r.website: r.emails for r in E.enrich_emails(business, pages, shown_only=True).collect()}
    assert mails == {"https://a.tw/": ["yes@a.tw", "and@a.tw", "link@a.tw"], "https://c.tw/": []}


# -- J4 ----------------------------------------------------------------------

@pytest.mark.parametrize("gram", [1, 2, 3, 5])
def test_blacklist_join_equals_every_test(spark, gram):
    rng = random.Random(gram)

    def word(n, letters="abAB.@"):
        return "".join(rng.choice(letters) for _ in range(n))
    values = [(i, None if i % 29 == 0 else word(rng.randrange(0, 9))) for i in range(400)] + [(1000, "ÄÖ.com"), (1001, "äö.com"), (1002, "日本語")]
    words = [(word(rng.randrange(2, 6)),) for _ in range(12)] + [("",), (None,), ("äÖ",), ("本",), ("zz-nowhere",)]
    df = spark.createDataFrame(values, "i long, v string").repartition(4)
    got = {r.i for r in R.anti_match_table(df, "v", spark.createDataFrame(words, "w string"), "w", gram).collect()}
    low = [w.lower() for w, in words if w]
    assert got == {i for i, v in values if v is None or not any(w in v.lower() for w in low)} and 0 < len(got) < len(values)
    none = spark.createDataFrame([("",), (None,)], "w string")
    assert R.anti_match_table(df, "v", none, "w").count() == len(values)
    assert R.anti_match_table(df.limit(0), "v", spark.createDataFrame(words, "w string"), "w").count() == 0


# -- V6 ----------------------------------------------------------------------

@pytest.mark.parametrize("parts", [1, 7])
def test_row_index_is_the_place_in_order(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rng = random.Random(5)
        rows = [(rng.randrange(40), i) for i in range(500)] + [(None, 1000)]
        df = spark.createDataFrame(rows, "a long, b long").repartition(6)
        got = V.with_row_index(df, F.col("a").desc(), "b").orderBy("row_index").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [r.row_index for r in got] == list(range(501))
    assert V.with_row_index(df.limit(0), "a").count() == 0


def test_violations_name_the_row(spark):
    rows = [("ChIJa", "1 Road", "123", 1), ("bad", "4.5 (12)", "200-400", 2), (None, None, None, 0)]
    df = spark.createDataFrame(rows, "placeId string, address string, phone string, k int")
    got = sorted(tuple(r) for r in V.violations_in_order(df, "k").select("row_index", "field").collect())
    assert got == [(0, "placeId"), (2, "address"), (2, "phone"), (2, "placeId")]


# -- R1 ----------------------------------------------------------------------

def plain_areas(points, most, levels):
    out = []

    def cut(level, x, y, inside):
        if not inside:
            return
        if len(inside) <= most or level == levels:
            out.append((level, x, y, len(inside)))
            return
        for dx, dy in ((0, 0), (0, 1), (1, 0), (1, 1)):
            cx, cy = 2 * x + dx, 2 * y + dy
            cut(level + 1, cx, cy, [p for p in inside if (p[0] >> levels - level - 1, p[1] >> levels - level - 1) == (cx, cy)])
    n = 1 << levels
    cut(0, 0, 0, [(min(max(int((lng + 180) // (360 / n)), 0), n - 1), min(max(int((lat + 90) // (180 / n)), 0), n - 1)) for lat, lng in points])
    return sorted(out)


@pytest.mark.parametrize("most,levels", [(1, 16), (10, 16), (5, 4), (10 ** 6, 16)])
def test_areas_are_the_leaves_of_a_quadtree(spark, most, levels):
    rng = random.Random(most)
    points = [(25 + rng.gauss(0, .01), 121 + rng.gauss(0, .01)) for _ in range(300)] + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)]
    points += [(25.5, 121.5)] * 40 + [(90.0, 180.0), (-90.0, -180.0)]
    df = spark.createDataFrame([*points, (None, 1.0), (1.0, None)], "lat double, lng double").repartition(5)
    got = sorted((r.level, r.cell_x, r.cell_y, r.n) for r in AN.area_density(df, "lat", "lng", most, levels).collect())
    assert got == plain_areas(points, most, levels) and sum(r[3] for r in got) == len(points)
