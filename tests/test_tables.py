"""Literal-table tests for requests, e-mails, checks, metrics and hours
(expected values from FIXTURES.md §4), plus stream-equals-batch for ST1."""

import datetime as dt

from placeweave.operators import emails as E
from placeweave.operators import hours as H
from placeweave.operators.phones import first_phone_expr
from placeweave.operators.relational import dedupe_first, limit_per_query, merge_details, one_per_key
from placeweave.plans import metrics as M
from placeweave.plans import quality as V
from placeweave.sources import requests as RQ


def _col(spark, values, dtype="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")


def test_o1_normalise(spark):
    df = spark.createDataFrame(
        [(1, " café & bar 台北 ", None, None, 500, None, None), (2, "", None, "ja", 10, True, None),
         (3, None, None, None, None, None, None), (4, None, "https://x/maps/search/a", None, 0, None, None)],
        RQ.REQUEST_SCHEMA)
    got = {r.request_id: r for r in RQ.normalise_requests(df).collect()}
    assert set(got) == {1, 4}
    assert got[1].query == "café & bar 台北" and got[1].max_results == 200 and got[1].language == "en"
    assert got[4].max_results == 100


def test_o2_url_labels(spark):
    urls = ["https://www.google.com/maps/search/pizza+taipei", "https://www.google.com/maps/search/caf%C3%A9/@25,121",
            "https://www.google.com/maps/place/x", "https://www.google.com/maps/search/bad%E0%A4%A"]
    got = [r[0] for r in _col(spark, urls).orderBy("i").select(RQ.url_label_expr("v")).collect()]
    assert got == ["pizza+taipei", "café", "Direct URL", None]


def test_o3_search_url_and_j1(spark):
    df = spark.createDataFrame([(1, "café & bar (台北)!", None, "zh-TW", 60, True, None)], RQ.REQUEST_SCHEMA)
    rows = RQ.with_search_url(RQ.expand_regions(df)).orderBy("region_pos").collect()
    assert [r.query for r in rows] == ["café & bar (台北)!"] + [f"café & bar (台北)! {r}" for r in RQ.DEFAULT_REGIONS[1:]]
    assert rows[0].search_url == ("https://www.google.com/maps/search/caf%C3%A9%20%26%20bar%20(%E5%8F%B0%E5%8C%97)!"
                                  "?hl=zh-TW")
    assert rows[0].non_ascii
    single = spark.createDataFrame([(2, "x", None, "en", 50, True, None)], RQ.REQUEST_SCHEMA)
    assert RQ.expand_regions(single).count() == 1            # multi only when max_results > 50


def test_e5_filter(spark):
    df = spark.createDataFrame([(["a@mail5.example.com", "noreply@x.com", "info@shop.tw", "bad@x"],)], "e array<string>")
    assert df.select(E.filter_emails_expr("e")).first()[0] == ["info@shop.tw"]


def test_e4_page_emails(spark):
    html = ('<html><body><p>Write INFO@shop.tw</p><script>x="hidden@shop.tw"</script>'
            '<a href="mailto:Sales@Shop.tw?subject=hi">s</a><a href="mailto:info@shop.tw">i</a></body></html>')
    got = spark.createDataFrame([(1, "https://shop.tw", html)], "page_id long, url string, html string") \
        .select(E.page_emails_expr("html")).first()[0]
    assert got == ["info@shop.tw", "sales@shop.tw"]


def test_l11_phone(spark):
    vals = ["x (02) 2345-6789", "call +886 2 8101 0701", "+1 312 555 1234", "0912-345-678", "none 200-400"]
    got = [r[0] for r in _col(spark, vals).orderBy("i").select(first_phone_expr("v")).collect()]
    assert got == ["(02) 2345-6789", "+886 2 8101 0701", "+1 312 555 1234", "0912-345-678", None]


def test_v1_v3(spark):
    ids = ["ChIJa", "hex_0x1:0x2", "ChIJa?x", "abc", None]
    got = [r[0] for r in _col(spark, ids).orderBy("i").select(V.place_id_ok("v")).collect()]
    assert got == [True, True, False, False, False]
    vals = ["4.9(200)", "200-400", None, "1 Main St"]
    df = _col(spark, vals).orderBy("i")
    assert [r[0] for r in df.select(V.address_ok("v")).collect()] == [False, True, True, True]
    assert [r[0] for r in df.select(V.phone_ok("v")).collect()] == [True, False, True, True]


def _log(spark, rows):
    return spark.createDataFrame(rows, M.RUN_LOG_SCHEMA)


def test_a1_summary(spark):
    t = dt.datetime(2024, 1, 1)
    log = _log(spark, [("1", "q", "c", "s", t, 1000, True, 3, None), ("2", "q", "c", "s", t, 1000, True, 4, None),
                       ("3", "q", "c", "s", t, 1000, False, None, "boom")])
    r = M.run_summary(log, by=None).first()
    assert (r.total_searches, r.total_results, r.failed_searches, r.avg_results_per_search, r.success_rate) == \
        (3, 7, 1, 2, "67%")


def test_a5_percentiles(spark):
    t = dt.datetime(2024, 1, 1)
    log = _log(spark, [(str(i), "q", "c", "s", t, i, True, 1, None) for i in range(1, 11)])
    r = {x.scenario: x for x in M.latency_percentiles(log).collect()}["ALL"]
    assert (r.p50, r.p90, r.p95, r.p99) == (6, 10, 10, 10)


def test_d4_hours_list(spark):
    entries = "array<struct<day:string,hours:string>>"
    df = spark.createDataFrame([
        (1, [("星期一", "09:00-18:00"), ("星期二", "09:00-18:00")]),
        (2, [("星期一", "休息"), ("星期二", "09:00-18:00")]),
        (3, [("Monday", "12:00–15:0017:30–22:00")]),
        (4, [("Sunday", "x"), ("Monday", "a"), ("Monday", "b")]),
        (5, [("Special (holiday)", "10:00–12:00營業時間可能不同"), ("Day 營業時間可能不同", "x")]),
    ], f"i int, e {entries}")
    got = {r.i: r.h for r in df.select("i", H.hours_list("e").alias("h")).collect()}
    assert got[1] == ["星期一: 09:00-18:00", "星期二: 09:00-18:00"]
    assert got[2] == ["星期一: 休息", "星期二: 09:00-18:00"]
    assert got[3] == ["Monday: 12:00–15:00 17:30–22:00"]
    assert got[4] == ["Monday: b", "Sunday: x"]                 # repeated key: last value wins
    assert got[5] == ["Special: 10:00–12:00"]


def test_w1_w3_and_merge(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (1, "b", 3), (2, "c", 1)], "q int, pid string, pos int")
    first = {(r.q, r.pid): r.pos for r in dedupe_first(df, ["q", "pid"], ["pos"]).collect()}
    assert first == {(1, "a"): 1, (1, "b"): 3, (2, "c"): 1}
    top = limit_per_query(df, "q", ["pos"], limit=2).collect()
    assert sorted((r.q, r.pos) for r in top) == [(1, 1), (1, 2), (2, 1)]
    listing = spark.createDataFrame([("p1", "old addr", None), ("p2", "keep", "$")],
                                    "placeId string, address string, priceLevel string")
    detail = spark.createDataFrame([("p1", "Opens 9 AM", "Inexpensive", 1), ("p1", "x", "y", 2), ("p2", "", None, 1)],
                                   "placeId string, address string, priceLevel string, o int")
    merged = {r.placeId: r for r in merge_details(listing, one_per_key(detail, "placeId", "o").drop("o"),
                                                  fields=("address", "priceLevel")).collect()}
    assert merged["p1"].address == "" and merged["p1"].priceLevel == "$$$$"   # C5/C3 after the test
    assert merged["p2"].address == "keep" and merged["p2"].priceLevel == "$"


def test_stream_equals_batch(spark, tmp_path):
    from placeweave.streaming.capture import latest_view, start_capture

    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(minutes=i), i % 3, "view", float(i), "{}") for i in range(30)]
    ddl = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    ev = spark.createDataFrame(rows, ddl)
    src = str(tmp_path / "landing")
    ev.write.parquet(src)
    ev.limit(10).write.mode("append").parquet(src)              # repeated deliveries
    q = start_capture(spark, src, ddl, str(tmp_path / "sink"), lambda b: b.select("user_id", "event_id", "ts", "value"),
                      key=["event_id"], event_time="ts", watermark="1 day", checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination()
    sink = spark.read.parquet(str(tmp_path / "sink"))
    assert sink.count() == 30                                     # repeats dropped
    got = {r.user_id: r.event_id for r in latest_view(spark, str(tmp_path / "sink"), "user_id", "ts", "event_id")
           .collect()}
    assert got == {0: 27, 1: 28, 2: 29}


def test_a5_approx_close_to_exact(spark):
    t = dt.datetime(2024, 1, 1)
    log = _log(spark, [(str(i), "q", "c", "s", t, i, True, 1, None) for i in range(1, 1001)])
    exact = {x.scenario: x for x in M.latency_percentiles(log).collect()}["ALL"]
    approx = {x.scenario: x for x in M.latency_percentiles_approx(log).collect()}["ALL"]
    for name in ("p50", "p90", "p95", "p99"):
        assert abs(getattr(exact, name) - getattr(approx, name)) <= 2


def test_x3_ignores_non_markup(spark):
    from placeweave.operators.pages import page_links

    html = ('<html><head><title>&lt;a href="/t"&gt;</title><script>var s=\'<a href="/s">\';</script></head>'
            '<body><!-- <a href="/c">x</a> --><a class="k" href="/p?a=1&amp;b=2">p</a>'
            "<a href='rel/q'>q</a><a name=x>no href</a><textarea><a href=\"/ta\"></textarea></body></html>")
    pages = spark.createDataFrame([(1, "https://h.test/dir/page.html", html)], "page_id long, url string, html string")
    got = [(r.pos, r.href, r.link_url) for r in page_links(pages).orderBy("pos").collect()]
    assert got == [(0, "/p?a=1&b=2", "https://h.test/p?a=1&b=2"), (1, "rel/q", "https://h.test/dir/rel/q")]


def test_listing_capture_stream(spark, tmp_path):
    from placeweave.plans.business_run import CAPTURED_PAGE_SCHEMA
    from placeweave.streaming.capture import latest_view, start_listing_capture

    def page(pid, t, name):
        html = (f'<div jsaction="mouseover:pane"><a href="https://m.test/maps/place/X/ChIJplace1"></a>'
                f'<div class="fontHeadlineSmall">{name}</div></div>')
        return (pid, "listing", 1, 0, None, "https://m.test/maps/search/x", t, html)

    t0 = dt.datetime(2024, 1, 1)
    first = spark.createDataFrame([page(1, t0, "Old Name")], CAPTURED_PAGE_SCHEMA)
    later = spark.createDataFrame([page(2, t0 + dt.timedelta(hours=5), "New Name"),
                                   page(1, t0, "Old Name")], CAPTURED_PAGE_SCHEMA)   # page 1 re-delivered
    src, sink = str(tmp_path / "pages"), str(tmp_path / "rows")
    first.write.parquet(src)
    start_listing_capture(spark, src, sink, checkpoint=str(tmp_path / "ck")).awaitTermination()
    later.write.mode("append").parquet(src)
    start_listing_capture(spark, src, sink, checkpoint=str(tmp_path / "ck")).awaitTermination()
    rows = spark.read.parquet(sink)
    assert rows.count() == 2                                      # the repeated page 1 was dropped
    latest = latest_view(spark, sink, "placeId", "captured_at", "page_id").collect()
    assert [(r.placeId, r.name) for r in latest] == [("ChIJplace1", "New Name")]


def test_a5_distributed_matches_brute_force(spark):
    import random

    rnd = random.Random(7)
    t = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        scen = "hot" if i % 3 else rnd.choice(["a", "b"])
        dur = 500 if (scen == "hot" and i % 2) else rnd.randint(1, 2000)   # a hot repeated value
        rows.append((str(i), "q", "c", scen, t, dur, True, 1, None))
    log = _log(spark, rows)
    answers = []
    for partitions, aqe, reuse in ((1, "true", "true"), (8, "false", "false"), (50, "true", "false")):
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            answers.append(sorted(M.latency_percentiles(log.repartition(partitions)).collect()))
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            spark.conf.set("spark.sql.exchange.reuse", "true")
    assert answers[0] == answers[1] == answers[2]
    got = {r.scenario: r for r in answers[0]}
    bands = {r.scenario: r.band for r in M.end_to_end_verdict(log, "scenario").collect()}
    assert bands == {"hot": "pass", "a": "pass", "b": "pass"}
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r[5])
        groups.setdefault("ALL", []).append(r[5])
    for g, vals in groups.items():
        vals.sort()
        for name, p in M.PERCENTILES:
            assert getattr(got[g], name) == vals[int(len(vals) * p)], (g, name)
        assert got[g].n == len(vals)


def test_r1_grid_and_r3_captured(spark):
    from placeweave.plans import analyses as AN

    biz = spark.createDataFrame([("a", "cafe", 25.001, 121.501, "https://a.tw"), ("b", "cafe", 25.002, 121.502, None),
                                 ("c", "bar", 25.051, 121.551, "https://c.tw")],
                                "placeId string, businessType string, lat double, lng double, website string")
    d = {(r.businessType, r.cell): r.n for r in AN.density(biz, ["businessType"], "lat", "lng", 0.01).collect()}
    assert d[("cafe", "2500:12150")] == 2 and d[("bar", "2505:12155")] == 1 and d[("ALL", "ALL")] == 3
    captured = spark.createDataFrame([("https://a.tw",), ("https://a.tw",)], "url string")
    got = sorted(r.placeId for r in AN.no_website(biz, captured).collect())
    assert got == ["b", "c"]                 # no website, or a website never captured


def test_hours_map_null_day(spark):
    df = spark.createDataFrame([([(None, "x"), ("Mon", "9")],)], "e array<struct<day:string,hours:string>>")
    assert dict(df.select(H.hours_map("e")).first()[0]) == {"Mon": "9"}


def test_e1_e7_eligibility(spark):
    biz = spark.createDataFrame([("a", "https://shop.tw"), ("b", "https://www.google.com/x"), ("c", None),
                                 ("d", "https://gone.tw")], "placeId string, website string")
    assert sorted(r.placeId for r in E.eligible_websites(biz).collect()) == ["a", "d"]
    site = spark.createDataFrame([(1, "https://shop.tw", "<p>hi@shop.tw</p>")], "page_id long, url string, html string")
    got = {r.placeId: (r.email, r.emails) for r in E.enrich_emails(biz, site).collect()}
    assert got == {"a": ("hi@shop.tw", ["hi@shop.tw"]), "b": (None, None), "c": (None, None), "d": (None, [])}


def test_helpers(spark):
    from pyspark.sql import functions as F

    from placeweave.functions.text import standardise
    from placeweave.operators.relational import anti_match

    biz = spark.createDataFrame([(" Cafe  One ", "4.5(200)", "Inexpensive", "0912-345-678", "shop.tw?x=1", "4.567", "1,234")],
                                "name string, businessType string, priceLevel string, phone string, website string, "
                                "rating string, reviews string")
    r = standardise(biz).first()
    assert (r.name, r.businessType, r.priceLevel, r.phone, r.website, r.rating, r.reviews) == \
        ("Cafe One", "", "$$$$", "+886 912 345 678", "https://shop.tw", 4.6, 1234)

    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, label string")
    good, bad = RQ.split_errors(df, F.when(F.col("label").isNull(), "URI malformed"))
    assert [r.id for r in good.collect()] == [1] and [(r.id, r.error) for r in bad.collect()] == [(2, "URI malformed")]

    mails = spark.createDataFrame([("a@x.tw",), ("NoReply@x.tw",), ("b@sentry.io",)], "e string")
    assert [r.e for r in anti_match(mails, "e", E.EMAIL_BLACKLIST).collect()] == ["a@x.tw"]

    rows = spark.createDataFrame([("q1", "ChIJa", "4.5(20)", "20-30"), ("q1", "bad?", None, None), ("q2", "hex_1", "x", "1")],
                                 "query string, placeId string, address string, phone string")
    assert [r.query for r in V.check_counts(rows, "query", min_rows=2).collect()] == ["q2"]
    assert [r.placeId for r in V.check_place_id(rows).collect()] == ["bad?"]
    assert [r.address for r in V.check_address(rows).collect()] == ["4.5(20)"]
    assert [r.phone for r in V.check_phone(rows).collect()] == ["20-30"]
    comp = {r.column: (r.non_null, r.total) for r in V.completeness(rows).collect()}
    assert comp == {"query": (3, 3), "placeId": (3, 3), "address": (2, 3), "phone": (2, 3)}
