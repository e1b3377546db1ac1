"""Golden cases of the rules, one table per function."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyroom.functions import classify, dates, links, rules, text
from tallyroom.operators import dedup, feed, linkjobs, prices, tables
from tallyroom.sources import feeds


def column(spark, values, f, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_categories(spark):
    cases = [
        ("ยุบสภา เลือกตั้งใหม่ต้นปีหน้า", "political", "TITLE", "MACRO"),
        ("TITLE คาดกำไรปี 69 โต", None, "TITLE", "COMPANY"),
        ("TITLE คาดกำไรปี 69 โต", None, "ASW", "COMPANY"),
        ("กนง. คงอัตราดอกเบี้ยนโยบาย 1.00%", None, "ASW", "RATES"),
        ("ยุบสภา", "political", "ASW", "POLITICS"),
        ("ศุภาลัย เปิดโครงการใหม่", None, "ASW", "COMPETITOR"),
        ("ตัวเลขส่งออกเดือน ก.ค.", None, "ASW", "MACRO"),
        (None, None, "ASW", "MACRO"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "t string, h string, p string")
    assert [r[0] for r in df.select(classify.category(F.col("t"), F.col("h"), F.col("p"))).collect()] == [c[3] for c in cases]


def test_mention_guard(spark):
    no = ["PHUKET TITLE DEED PROBE", "SET TITLE SPONSOR DEAL", "the title of the article"]
    yes = ["หุ้น TITLE เทรด SET วันแรก", "The Title Heritage Bang-Tao ยอดขายทะลุเป้า", "Rhom Bho Property posts record H1"]
    assert column(spark, no + yes, classify.mentions_title) == [False] * 3 + [True] * 3


def test_event_fingerprints(spark):
    same = ["รัฐต่ออายุลดค่าโอน-จดจำนอง และผ่อนคลาย LTV ถึงกลางปี 70", "รัฐขยายมาตรการลดค่าโอน-จดจำนองถึงกลางปี 70", "รัฐขยายมาตรการลดค่าโอน-จำนองถึงกลางปี 70"]
    got = column(spark, [*same, "ASW โชว์กำไร Q2/69 โต 36%"], classify.event_fingerprint)
    assert len(set(got[:3])) == 1 and got[0] and got[3] is None


def test_event_clusters(spark):
    d = datetime.date
    rows = [(3, d(2026, 8, 4), "a"), (1, d(2026, 8, 2), "a"), (2, d(2026, 8, 4), "a"), (7, d(2025, 6, 1), "b"), (8, d(2026, 6, 1), "b")]
    rows += [(20 + i, d(2026, 8, 4), None) for i in range(3)]  # no policy measure: grouped with nothing
    df = spark.createDataFrame(rows, "id int, date date, fingerprint string").withColumns({"panel": F.lit("p"), "title": F.lit("t")})
    got = dedup.event_clusters(df).collect()
    assert sorted((r.keep, r.duplicate) for r in got) == [(1, 2), (1, 3)]


def test_numbers(spark):
    got = column(spark, ["ถึงกลางปี 70", "ถึงกลางปี 2570", "ลดเหลือ 0.01%", "มูลค่า 7 ล้านบาท", "11,847 units"], classify.numbers_in)
    assert got == [["yr:2027"], ["yr:2027"], ["pct:0.01"], ["amt:7"], ["num:11847"]]


def test_site_suffix(spark):
    assert column(spark, ["ASW โชว์กำไร | Bangkok Post", "ASW - แนะนำซื้อ"], classify.strip_site_suffix) == ["ASW โชว์กำไร", "ASW - แนะนำซื้อ"]


def test_near_duplicates(spark):
    titles = ["ASW รายงานผลประกอบการ Q1/69 รายได้ 2,162 ล้านบาท", "ASW รายงานผลประกอบการ Q2/69 รายได้ 3,410 ล้านบาท", "Company lifts its presale target to 11,847 million", "Company lifts presale target to 11,847 million"]
    df = spark.createDataFrame([(i, "p", t, datetime.date(2026, 1, 1 + i % 2), "s") for i, t in enumerate(titles)], "id long, panel string, title string, date date, source_label string")
    assert [(r.a, r.b) for r in dedup.near_dup_pairs(dedup.headline_keys(df)).collect()] == [(2, 3)]


def test_near_duplicates_against_brute_force(spark, sf):
    from tallyroom.plans.adapters import news

    rows = dedup.headline_keys(news(spark, sf, 10)).collect()
    want = set()
    jac = lambda x, y: len(x & y) / len(x | y) if x and y else 0
    for i, a in enumerate(rows):
        for b in rows[:i]:
            x, y, m, n = set(a.shingles), set(b.shingles), set(a.numbers), set(b.numbers)
            if a.panel == b.panel and abs((a.date - b.date).days) <= 2 and x and y:
                alike = jac(x, y) >= 0.5 or (len(x & y) / min(len(x), len(y)) >= 0.62 and min(len(a.norm), len(b.norm)) >= 20)
                if alike and not (m and n and jac(m, n) < 0.5):
                    want.add((min(a.id, b.id), max(a.id, b.id)))
    got = {(r.a, r.b) for r in dedup.near_dup_pairs(dedup.headline_keys(news(spark, sf, 10))).collect()}
    assert got == want
    kept = []
    for i in sorted(r.id for r in rows):
        if not any((k, i) in want for k in kept):
            kept.append(i)
    pairs = spark.createDataFrame(sorted(want), "a long, b long")
    assert sorted(r.id for r in dedup.first_kept(news(spark, sf, 10).select("id"), pairs).collect()) == kept


def test_hours_between_headlines(spark):
    ts = lambda h: datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=h)
    df = spark.createDataFrame([(i, "p", "Company lifts presale target to eleven million", ts(h), "s") for i, h in enumerate((0, 30, 70))], "id long, panel string, title string, date timestamp, source_label string")
    pairs = lambda hours: sorted((r.a, r.b) for r in dedup.near_dup_pairs(dedup.headline_keys(df), hours).collect())
    assert pairs(12) == [] and pairs(36) == [(0, 1)] and pairs(48) == [(0, 1), (1, 2)] and len(pairs(96)) == 3


def test_long_chains_of_copies_are_resolved(spark):
    """Each row matches the next: every other one stays, however long the chain."""
    ids = spark.range(31)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    assert sorted(r.id for r in dedup.first_kept(ids, pairs).collect()) == list(range(0, 31, 2))


def test_rescale(spark):
    d = datetime.date
    points = lambda *v: spark.createDataFrame([(d(2026, 8, 11 + i), float(x)) for i, x in enumerate(v)], "date date, close double")
    run = lambda p, s: [round(r.close, 4) for r in prices.rescale_to_stored(p, s).orderBy("date").collect()]
    assert run(points(100, 101, 99.5), points(67)) == [67.0, 67.67, 66.665]
    assert run(points(100, 102), points(50, 999)) == [50.0, 51.0]
    for stored in (points(), points(0), points(-5), points(float("nan")), points(100)):
        assert run(points(100), stored) == [100.0]


def test_prices_with_gaps(spark):
    rows = [("a", datetime.date(2026, 1, 1), 10.0), ("a", datetime.date(2026, 1, 2), None), ("a", datetime.date(2026, 1, 3), 12.0), ("b", datetime.date(2026, 1, 3), 5.0)]
    df = spark.createDataFrame(rows, "ticker string, date date, close double").withColumn("volume", F.lit(1))
    assert [r.change for r in prices.pct_change(df).orderBy("ticker", "date").collect()] == [None] * 4
    assert [(r.ticker, r.change) for r in prices.peer_change(df).orderBy("ticker", "date").collect()] == [("a", None), ("a", None), ("b", None)]
    got = prices.asof_close(spark.createDataFrame([("a", datetime.date(2026, 1, 3)), ("b", datetime.date(2026, 1, 3))], "ticker string, date date"), df)
    assert sorted((r.ticker, r.asof_close) for r in got.collect()) == [("a", 10.0), ("b", None)]


def test_links(spark):
    dirty = {
        "https://a.co/x / https://b.co/y": "https://a.co/x",
        "https://a.co/Detail/1169,": "https://a.co/Detail/1169",
        "https://a.co/a (note)": "https://a.co/a",
        "https://a.co/a)": "https://a.co/a",
        "https://en.a.org/wiki/Foo_(disambiguation)": "https://en.a.org/wiki/Foo_(disambiguation)",
        "https://vertexaisearch.cloud.google.com/x": "",
        "javascript:alert(1)": "",
        "NONE": "",
        None: "",
    }
    assert column(spark, list(dirty), links.sanitize_url) == list(dirty.values())
    forms = {
        "https://WWW.Example.COM/news/123/#section": "https://www.example.com/news/123",
        "https://a.co/news/1?utm_source=x&utm_medium=y&id=7": "https://a.co/news/1?id=7",
        "https://a.co:443/news/1": "https://a.co/news/1",
        "https://a.co//news//1//": "https://a.co/news/1",
        "http://a.co/": "http://a.co/",
        "not a url": "not a url",
    }
    assert column(spark, list(forms), links.canonical_url) == list(forms.values())
    home = [f"https://a.co{p}" for p in ("/", "/home", "/category/business/3", "/topic/property/page/5", "/search/asw")]
    article = [f"https://a.co{p}" for p in ("/business/1234567", "/2026/08/03/set-august-3-2569/", "/news?newsid=884412", "/th/v2/article/LPR0w3L")]
    assert column(spark, home + article, links.link_shape) == ["homepage"] * 5 + ["article"] * 4
    bad = ["http://10.0.0.1/x", "http://127.0.0.1/", "http://169.254.169.254/latest", "http://100.64.0.1/", "http://224.0.0.1/", "http://localhost/x", "ftp://a.co/x", "http://u:p@a.co/x", "http://192.168.1.1/", "http://172.20.1.1/", None]
    assert column(spark, [*bad, "http://203.0.113.9/x"], links.link_safety) == ["unsafe"] * len(bad) + ["ok"]


def test_records(spark):
    block = "CATEGORY: [COMPANY]\nHEADLINE: one\nSUMMARY: s SOURCE: x\nEVENT_DATE: 2569-08-15\nPUBLISH_DATE: 2026-08-17"
    two = "CATEGORY: TOURISM HEADLINE: two\nCATEGORY: FX\nHEADLINE: three\nPUBLISH_DATE: 2026-08-17"
    df = spark.createDataFrame([(1, block + "\n---\n" + two), (2, "NONE"), (3, None)], "id int, text string")
    got = {r.headline: r for r in feeds.load_records(df, ["COMPANY", "FX"], "2026-09-01").collect()}
    assert {k: (r.category, str(r.date), r.impact_level) for k, r in got.items()} == {"one": ("COMPANY", "2026-08-15", "MEDIUM"), "two": ("MACRO", "2026-09-01", "MEDIUM"), "three": ("FX", "2026-08-17", "MEDIUM")}
    assert got["one"].summary == "s" and got["one"].source == "x"


def test_page_titles(spark):
    pages = {
        '<meta property="og:title" content="A"><title>x</title>': ("A", "og"),
        '<meta content="B" property="og:title">': ("B", "og"),
        '<meta name="twitter:title" content="C">': ("C", "twitter"),
        '<script type="application/ld+json">{"headline": "D"}</script>': ("D", "json_ld"),
        '<script type="application/ld+json">{"@graph": [{"headline": "E"}]}</script>': ("E", "json_ld"),
        "<title>F &amp; G</title><h1>h</h1>": ("F & G", "title"),
        "<h1>H</h1>": ("H", "h1"),
    }
    assert [tuple(x) for x in column(spark, list(pages), feeds.page_title)] == list(pages.values())


def test_eras_and_truncation(spark):
    assert column(spark, ["2568-07-04", "2025-07-04 x", "2568-7-4", None], dates.normalize_era) == ["2025-07-04", "2025-07-04 x", "2568-7-4", None]
    assert column(spark, ["short", "x" * 120, "word " * 30], text.truncate_headline) == ["short", "x" * 100 + "…", ("word " * 20).strip() + "…"]


def test_deletion_is_checked(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "id int")
    stay, gone = tables.delete_rows(df, df.where("id < 2"), 2)
    assert (stay.count(), gone.count()) == (3, 2)
    with pytest.raises(ValueError):
        tables.delete_rows(df, df.where("id < 2"), 3)
    with pytest.raises(ValueError):
        feed.actionable(df, ["unknown"])


def test_remark_columns(spark):
    df = spark.createDataFrame([(None, "s", "m"), ("c", None, None), ("", None, None)], "a string, b string, c string")
    got = [tuple(r[0]) for r in df.select(classify.remarks(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [("s", "sector"), ("c", "company"), (None, None)]
    assert column(spark, ["ดอกเบี้ย", "x", ""], rules.remark_bucket) == ["macro", "other", None]


def test_crawl_verdicts(spark):
    rows = [(200, None, "a title", "https://a.co/news/12345"), (410, None, "", "https://a.co/1"), (200, None, "404 - Not Found", "https://a.co/news/12345"), (200, None, "t", "https://a.co/"), (200, None, "t", "http://10.0.0.1/x"), (None, "dns", "", "https://a.co/1")]
    df = spark.createDataFrame(rows, "s int, e string, t string, u string")
    got = [r[0] for r in df.select(linkjobs.crawl_verdict(F.col("s"), F.col("e"), F.col("u"), F.col("t"))).collect()]
    assert got == ["valid", "dead", "soft_404", "homepage", "unsafe", "network_error"]


def test_longest_common_run(spark):
    import random

    from tallyroom.operators.audits import lcs_containment

    def brute(a, b):
        a, b = sorted((a, b), key=len)
        return max((k for i in range(len(a)) for k in range(len(a) - i + 1) if a[i : i + k] in b), default=0) / len(a) if a else 0.0

    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abc1") for _ in range(rng.randint(0, 12))), "".join(rng.choice("abc1") for _ in range(rng.randint(0, 20)))) for i in range(200)]
    got = {r.id: r.containment for r in lcs_containment(spark.createDataFrame(rows, "id int, a string, b string")).collect()}
    assert got == pytest.approx({i: brute(*((a, b) if len(a) <= len(b) else (b, a))) for i, a, b in rows})


def test_title_verdicts(spark):
    from tallyroom.operators.audits import title_verdicts

    rows = [
        (1, "ASW โชว์กำไร Q2/69 โต 36%", "ASW โชว์กำไร Q2/69 โต 36% | Bangkok Post", "bangkokpost.com"),
        (2, "ASW โชว์กำไร Q2/69 โต 36%", "MSN", "msn.com"),
        (3, "qqqq wwww", "ผลฟุตบอลเมื่อคืน", "a.co"),
        (4, "", "x title", "a.co"),
    ]
    got = {r.id: r.verdict for r in title_verdicts(spark.createDataFrame(rows, "id int, headline string, page_title string, host string")).collect()}
    assert got == {1: "match", 2: "title_unknown", 3: "title_mismatch_high", 4: "title_unknown"}


def test_url_claims_last_over_batches(spark):
    from tallyroom.operators.audits import claim_urls

    claims = spark.createDataFrame([], "panel string, url string, title string, claimed_on date")
    batch = lambda *rows: spark.createDataFrame(rows, "id int, panel string, url string, title string")
    u = "https://a.co/news/12345"
    out, claims = claim_urls(batch((1, "p", u, "alpha beta gamma"), (2, "p", u, "delta epsilon zeta"), (3, "q", u, "delta epsilon zeta")), claims, "2026-01-01")
    assert {r.id: r.url_kept for r in out.collect()} == {1: u, 2: None, 3: u}
    out, later = claim_urls(batch((4, "p", u, "delta epsilon zeta"), (5, "p", u, "alpha beta gamma again")), claims, "2026-01-10")
    assert {r.id: r.url_kept for r in out.collect()} == {4: None, 5: u} and later.count() == 2
    out, later = claim_urls(batch((6, "p", u, "delta epsilon zeta")), claims, "2026-03-01")
    assert [r.url_kept for r in out.collect()] == [u]


def test_brief_sections(spark):
    text = "KEY_POINTS: headline1 • headline2 • headline3\nTONE: MEDIUM\nLAST_WEEK:\n- one\n- two\nEND: x"
    assert column(spark, [text], lambda c: feeds.bullets(feeds.section(c, "KEY_POINTS"))) == ["headline1\nheadline2\nheadline3"]
    assert column(spark, [text], lambda c: feeds.bullets(feeds.section(c, "LAST_WEEK"))) == ["- one\n- two"]
    assert column(spark, [text], lambda c: feeds.tone(feeds.section(c, "TONE"))) == ["neutral"]
    assert column(spark, ["a - b - c", "plain", None], feeds.bullets) == ["a\nb\nc", "plain", ""]
    assert column(spark, ["Bullish (x)", "bear", "", None], feeds.tone) == ["bullish", "bearish", "neutral", "neutral"]


def test_publisher_urls(spark):
    tracked = "http://www.b.co/apiclick.aspx?ref=x&amp;url=https%3a%2f%2fa.co%2fnews%2f1&amp;c=1"
    assert column(spark, [tracked, "https://a.co/news/1", "https://a.co/", "", None], links.publisher_url) == ["https://a.co/news/1", "https://a.co/news/1", "", "", ""]


def test_required_aliases(spark):
    got = column(spark, ["แอสเซทไวส์ เสนอขายหุ้นกู้ชุดใหม่", "SPALI profit", "SNAP rises", None], classify.required_aliases)
    assert got == [["ASW", "Assetwise", "แอสเซทไวส์", "แอสเสทไวส์"], ["SPALI", "ศุภาลัย"], [], []]


def test_digest_upsert_and_reads(spark):
    d = datetime.date
    names = "panel string, date date, headline string, generated_at int"
    target = spark.createDataFrame([("p", d(2026, 1, 1), "old", 1), ("p", d(2026, 1, 2), "stays", 1)], names)
    updates = spark.createDataFrame([("p", d(2026, 1, 1), "first", 2), ("p", d(2026, 1, 1), None, 3), ("q", d(2026, 1, 1), "new", 2)], names)
    out = tables.upsert_digest(target, updates)
    assert sorted((r.panel, r.date.day, r.headline) for r in out.where("headline is not null").collect()) == [("p", 2, "stays"), ("q", 1, "new")]
    assert out.count() == 3
    assert sorted((r.panel, r.date.day) for r in feed.read_digest(out).collect()) == [("p", 2), ("q", 1)]
    assert feed.read_digest(out, "2026-01-01").count() == 2 and feed.read_digests(out).count() == 3


def test_second_reclassification_finds_replaced_categories(spark):
    from pyspark.sql import functions as F

    from tallyroom.operators import feed

    df = spark.createDataFrame([(1, "political", "x"), (2, "other", "phuket"), (3, "other", "rate")], "id int, category string, title string")
    run = lambda t: feed.reclassify(t, [(F.col("title") == "rate", "RATES"), (F.col("category") == "political", "POLITICS")], "MACRO", [("MACRO", F.col("title") == "phuket", "TOURISM")])
    once = run(df)
    assert [r.category for r in once.orderBy("id").collect()] == ["POLITICS", "TOURISM", "RATES"]
    assert [r.category for r in run(once.drop("category_before")).orderBy("id").collect()] == ["MACRO", "TOURISM", "RATES"]
    assert feed.category_moves(once).count() == 3


def test_links_that_cannot_be_claimed_share_no_window(spark):
    rows = [(1, "p", "alpha beta gamma", None), (2, "p", "delta epsilon zeta", None), (3, "p", "alpha beta gamma", "https://a.co/news/12345"), (4, "p", "delta epsilon zeta", "https://a.co/news/12345"), (5, "p", "x", "https://a.co/"), (6, "p", "y", "https://a.co/")]
    got = linkjobs.clear_collisions(spark.createDataFrame(rows, "id int, panel string, title string, url string")).collect()
    assert {r.id: r.url_kept for r in got} == {1: None, 2: None, 3: rows[2][3], 4: None, 5: rows[4][3], 6: rows[5][3]}
