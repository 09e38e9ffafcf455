"""D1–D12 on captured detail pages with hand-derived expectations."""

from placeweave.operators.details import FACILITY_WORDS, detail_fields
from placeweave.operators.elements import page_elements

DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

TW = ("<html><body><h1>Shop TW</h1>"
      '<button data-item-id="address" aria-label="Address: No. 7, Sec. 5, Xinyi Rd, Xinyi District, Taipei City, '
      'Taiwan 110"><div>No. 7</div></button>'
      '<button aria-label="Phone: 02-2345-6789">02-2345-6789</button>'
      '<a aria-label="Website: shop.tw" href="https://shop.tw/?utm=1">shop.tw</a>'
      '<table class="eK4R0e">'
      + "".join(f"<tr><td>{d}</td><td>{'12:00–15:0017:30–22:00' if d == 'Friday' else '09:00–18:00'}</td></tr>"
                for d in DAYS)
      + '</table><button jsaction="pane.rating.category">Coffee shop</button>'
      '<span aria-label="Price level: $$">$$</span></body></html>')

JP = ('<html><body><button aria-label="Address: 〒1000001 Tokyo, Chiyoda, 1-1, Japan">addr</button>'
      '<button aria-label="Open 24 hours">Open 24 hours</button>'
      '<div class="hours-panel"><ul><li>Monday: 24 hours</li><li>Tuesday: 24 hours</li></ul></div>'
      '<span>4星級</span><div data-attrid="kc:/local:review">Great food $$$ place</div></body></html>')

KR = ('<html><body><button data-item-id="address" aria-label="주소: Jung-gu, Seoul, South Korea, 04524">x</button>'
      '<button aria-label="Price: Moderate">info</button></body></html>')

US = ('<html><body><button data-item-id="address" aria-label="Address: 350 5th Ave, New York, NY 10118, '
      'United States">350 5th Ave</button>'
      '<button aria-label="Phone: +1 212-736-3100">Call</button>'
      '<div><span>Pool: 6:00 AM - 10:00 PM</span></div>'
      '<div>Hours 9:00 AM - 5:00 PM daily</div>'
      '<span>Open 24 hours: 12:00 AM</span><p>$$</p></body></html>')

ZH = ('<html><body><table><tr><td>星期一</td><td>09:00–18:00</td></tr><tr><td>星期二</td><td>休息</td></tr></table>'
      '<div>Prices are moderate here</div></body></html>')


def test_detail_fixture(spark):
    pages = spark.createDataFrame(
        [(11, "https://maps.test/place/tw", TW), (12, "https://maps.test/place/jp", JP),
         (13, "https://maps.test/place/kr", KR), (14, "https://maps.test/place/us", US),
         (15, "https://maps.test/place/zh", ZH)], "page_id BIGINT, url STRING, html STRING")
    got = {r.page_id: r for r in detail_fields(page_elements(pages)).collect()}

    tw = got[11]
    assert tw.address == "No. 7, Sec. 5, Xinyi Rd, Xinyi District, Taipei City, Taiwan 110"
    assert tw.phone == "02-2345-6789"
    assert tw.website == "https://shop.tw/?utm=1"
    assert tw.hours == [f"{d}: 09:00–18:00" if d != "Friday" else "Friday: 12:00–15:00 17:30–22:00" for d in DAYS]
    assert tw.hoursDetail["Friday"] == "12:00–15:0017:30–22:00"
    assert tw.priceLevel == "$$"
    assert tw.businessType == "Coffee shop"

    jp = got[12]
    assert jp.address == "〒100-0001 Tokyo, Chiyoda, 1-1, Japan"
    assert jp.hours == ["Monday: 24 hours", "Tuesday: 24 hours"] + [f"{d}: 24 小時營業" for d in DAYS[2:]]
    assert jp.priceLevel == "$$$"
    assert jp.businessType == "4星級"
    assert jp.phone is None and jp.website is None

    kr = got[13]
    assert kr.address == "04524 Jung-gu, Seoul, South Korea"
    assert kr.hours is None and kr.hoursDetail is None
    assert kr.priceLevel == "$$"
    assert kr.businessType is None

    us = got[14]
    assert us.address == "350 5th Ave, New York, NY 10118, United States"
    assert us.phone == "+1 212-736-3100"
    assert us.hours == ["Open 24 hours: 12:00 AM"]
    assert us.priceLevel == "$$"

    zh = got[15]
    assert zh.hours == ["星期一: 09:00–18:00", "星期二: 休息"]
    assert dict(zh.hoursDetail) == {"星期一": "09:00–18:00", "星期二": "休息"}
    assert zh.priceLevel == "$$"


D5 = ('<html><body><button data-item-id="oh" aria-label="Hours: Open ⋅ Closes 9 PM ">x</button>'
      '<button aria-label="Price: $$$">info</button>'
      '<button jsaction="pane.category">· • Ramen restaurant</button></body></html>')

D7 = ('<html><body><button aria-label="Address: 12 Rd">Address: 12 Rd</button>'
      '<div>Now: <span>Open</span> ⋅ Closes 10 PM</div>'
      '<button aria-label="Info"><span>··</span></button>'
      '<p>Very Expensive tastes</p></body></html>')

D11 = ('<html><body><button data-item-id="address">Jung-gu, Seoul 04524, South Korea</button>'
       '<div>price: <span>$$</span></div><button aria-label="x">$$$</button>'
       '<p>cheap eats</p></body></html>')


def test_detail_fallbacks(spark):
    pages = spark.createDataFrame([(21, "u", D5), (22, "u", D7), (23, "u", D11)],
                                  "page_id BIGINT, url STRING, html STRING")
    got = {r.page_id: r for r in detail_fields(page_elements(pages)).collect()}
    d5 = got[21]
    assert d5.hours == ["Hours: Open ⋅ Closes 9 PM"]          # D5: label text, private use removed
    assert d5.priceLevel == "$$$"                            # D11 stage 3: symbols in a price label
    assert d5.businessType == "Ramen restaurant"             # D12: bullets stripped
    d7 = got[22]
    assert d7.hours == ["Now: Open ⋅ Closes 10 PM"]          # D7: parent text of the status span
    assert d7.address == "12 Rd"
    assert d7.priceLevel == "$$"                             # D11 stage 2: '··' inside a labelled button
    d11 = got[23]
    assert d11.address == "04524 Jung-gu, Seoul , South Korea"  # D8 from button text, Korea rule (as the JS does)
    assert d11.priceLevel == "$$"                            # stage 2: '$$' with 'price' context
    assert d11.hours is None


PANEL = ('<html><body><button aria-label="Hours: Open ⋅ Closes 10 PM">Open</button>'
         '<table class="hours-table"><tr><td>Monday (Labor Day)</td><td>Closed</td></tr>'
         '<tr><td>Tuesday</td><td>10 AM–10 PM</td></tr><tr><td>複製營業時間</td><td>x</td></tr></table>'
         '</body></html>')


def test_d2_panel_table(spark):
    pages = spark.createDataFrame([(31, "u", PANEL)], "page_id BIGINT, url STRING, html STRING")
    r = detail_fields(page_elements(pages)).first()
    # D1 found only 2 days; a panel exists, so its (cleaned) rows win
    assert r.hours == ["Monday: Closed", "Tuesday: 10 AM–10 PM"]
    assert dict(r.hoursDetail) == {"Monday": "Closed", "Tuesday": "10 AM–10 PM"}


def test_weekly_entries_do_not_run_the_hours_text(spark):
    """Whoever reads the weekly entries alone does not pay for D5–D7, and gets
    the same entries as whoever reads all fields."""
    week = "<table>" + "".join(f"<tr><td>{d}</td><td>09:00–17:00</td></tr>" for d in ("Monday", "Tuesday")) + "</table>"
    pages = [(1, "u", f"<body>{week}</body>"), (2, "u", "<body><button aria-label='Hours: Open 9 AM to 5 PM'></button></body>"),
             (3, "u", "<body></body>"), (4, "u", None)]
    fields = detail_fields(page_elements(spark.createDataFrame(pages, "page_id long, url string, html string")))

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()
    weekly = fields.select("page_id", "hours_entries", "hoursDetail")
    assert FACILITY_WORDS[0] in plan(fields) and FACILITY_WORDS[0] not in plan(weekly)
    days = [("Monday", "09:00–17:00"), ("Tuesday", "09:00–17:00")]
    got = {r["page_id"]: (r["hours_entries"], r["hoursDetail"]) for r in weekly.collect()}
    assert [tuple(x) for x in got[1][0]] == days and got[1][1] == dict(days) and [got[i] for i in (2, 3, 4)] == [(None, None)] * 3
    whole = {r["page_id"]: r for r in fields.collect()}
    assert {k: (r["hours_entries"], r["hoursDetail"]) for k, r in whole.items()} == got
    assert whole[1]["hours"] == [f"{d}: {h}" for d, h in days] and whole[2]["hours"] == ["Hours: Open 9 AM to 5 PM"]
