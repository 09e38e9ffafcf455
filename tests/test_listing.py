"""X1 + L1–L12 + W1 on an HTML listing fixture with hand-derived goldens."""

import os

from pyspark.sql import functions as F

from placeweave.operators.elements import flatten_html, page_elements
from placeweave.operators.listing import listings
from placeweave.operators.placeids import generated_id, js_string_hash

HERE = os.path.dirname(__file__)


def _page(spark, rows):
    return spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")


def _listing_html():
    with open(os.path.join(HERE, "fixtures", "listing_page.html"), encoding="utf-8") as fh:
        return fh.read()


def test_flatten_text_ranges():
    text, rows = flatten_html("<div><p>a<b>b</b><p>c</div><script>x='</p>'</script>")
    tags = [r[4] for r in rows]
    assert tags == ["html", "head", "body", "div", "p", "b", "p", "script"]
    assert [text[r[6]:r[7]].decode() for r in rows[3:]] == ["abc", "ab", "b", "c", "x='</p>'"]
    assert rows[3][3] == 6 and rows[4][3] == 5     # last descendant


def test_listing_fixture(spark):
    pages = _page(spark, [(1, "https://www.google.com/maps/search/cafe", _listing_html()),
                          (2, "https://x.test/", '<a href="/maps/place/X/ChIJzzz">Top</a>')])
    got = listings(page_elements(pages)).orderBy("page_id", "pos").collect()
    rows = [(r.page_id, r.pos, r.name, r.placeId, r.latitude, r.longitude, r.rating, r.reviews, r.address,
             r.businessType, r.phone) for r in got]
    assert rows == [
        (1, 0, "Cafe One", "ChIJaaa111", 25.0339, 121.5644, 4.6, 1234, "12 Main St", "Tea house", "(02) 2345-6789"),
        (1, 3, "Bar Two", "hex_0x3442abb6:0x1f2", 25.1, 121.2, None, 0, "2 Cd Rd", "Bar", "+886 2 8101 0701"),
        (1, 4, "星巴克", "generated_75fs6", 25.0, 121.5, None, 200, "信義路五段7號", "餐廳", None),
    ]
    assert got[0].url.startswith("https://www.google.com/maps/place/Cafe+One/")


def _js_hash_model(s: str) -> int:
    h = 0
    units = s.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = ((h << 5) - h + int.from_bytes(units[i:i + 2], "big")) & 0xFFFFFFFF
    return h - (1 << 32) if h >= (1 << 31) else h


def test_js_hash_matches_model(spark):
    vals = ["星巴克_25.0_121.5", "Cafe_1_2", "😀 emoji_-1.5_3", "a" * 200]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(js_string_hash(F.col("v"))).collect()]
    assert got == [_js_hash_model(v) for v in vals]
    gid = df.select(generated_id(F.lit("星巴克"), F.lit("25.0"), F.lit("121.5"))).first()[0]
    assert gid == "generated_75fs6"


CARDS_2 = (
    '<html><body><div role="feed">'
    '<div data-cid="1"><a href="/maps/place/A/data=!19sChIJa19"></a><span role="heading">甲店</span>'
    '<span role="img" aria-label="4.2 星">4.2</span><div class="W4Efsd">咖啡廳 · 台北市信義路1號</div></div>'
    '<div jsaction="x"><a href="https://m.test/maps/place/B" data-pid="ChIJdp"><div>Bee</div></a>(12)</div>'
    '<div jsaction="mouseover:pane.c" data-pid="ChIJparent"><a href="/maps/place/C"><div>Cee</div></a></div>'
    "</div></body></html>")


def test_listing_fixture_branches(spark):
    pages = _page(spark, [(7, "https://m.test/maps/search/q", CARDS_2)])
    got = [(r.pos, r.name, r.placeId, r.rating, r.reviews, r.address, r.businessType)
           for r in listings(page_elements(pages)).orderBy("pos").collect()]
    assert got == [
        (0, "甲店", "ChIJa19", 4.2, 0, "台北市信義路1號", "咖啡廳"),   # data-cid container, heading, 星, L10
        (1, "Bee", "ChIJdp", None, 12, None, None),                    # jsaction container, link data-pid
        (2, "Cee", "ChIJparent", None, 0, None, None),                 # parent data-pid
    ]


def test_flatten_deep_unclosed_is_linear():
    import time

    html = "<div>" * 20000 + "<p>x" * 2000 + "</span>" * 2000
    t = time.perf_counter()
    text, rows = flatten_html(html)
    assert time.perf_counter() - t < 3.0          # was ~9 s with a stack scan per tag
    assert len(rows) == 22003 and text == b"x" * 2000
    assert max(r[2] for r in rows) < 520          # browsers stop nesting there too
