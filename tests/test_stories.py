"""Duplicate stories by classes and components, claims on links over batches, curation, publishers, relevance, page metadata."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyroom.functions import links, publishers, rules, text
from tallyroom.operators import audits, dedup, feed, graph, linkjobs
from tallyroom.operators.scratch import Kept, exists
from tallyroom.plans.adapters import news
from tallyroom.sources import feeds
from tallyroom.streaming import jobs


def stories(spark, rows):
    return spark.createDataFrame([(i, p, t, datetime.date(2024, 1, 1) + datetime.timedelta(days=d), "s") for i, p, t, d in rows], "id long, panel string, title string, date date, source_label string")


def test_shingles_are_linear_and_whole(spark):
    long = "".join(chr(0x4E00 + i % 5000) for i in range(200_000)) + "🙂é"
    row = spark.createDataFrame([(long,), ("ab",), ("🙂éa",), ("",), (None,)], "t string").select(F.size(text.shingles(F.col("t"))).alias("n"), F.length(F.get(text.ngrams(F.col("t"), 3), 0)).alias("first"), F.col("t")).collect()
    assert [(r.n, r.first) for r in row] == [(5_002, 3), (0, None), (1, 3), (0, None), (0, None)]


def test_same_story_counts_repeats(spark):
    rows = [("aaa aaa bbb ccc", "aaa bbb ddd"), ("aaa bbb", "aaa bbb ccc"), ("aaa", "aaa"), ("", "aaa"), (None, None), ("xxx yyy zzz", "aaa bbb ccc")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(text.same_story(F.col("a"), F.col("b"))).collect()]
    assert got == [True, True, False, False, False, False]


def test_token_overlap_counts_contained_tokens(spark):
    rows = [("aaaa bbbb aaaa zzzz", "xaaaax bbbb"), ("abc", "abc"), ("", ""), (None, None), ("aaaa", None), ("longword", "long word"), ("bbbb bbbb", "bbbb")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(text.token_overlap(F.col("a"), F.col("b"))).collect()]
    assert got == [0.75, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def test_components_and_choice_against_a_loop(spark):
    rng = random.Random(3)
    for fold in (0, 4, 100_000):
        pairs = {tuple(sorted(rng.sample(range(120), 2))) for _ in range(110)} | {(200 + i, 201 + i) for i in range(40)}
        kept = Kept(spark, "test")
        df = spark.createDataFrame([p if rng.random() < 0.5 else p[::-1] for p in pairs] * 2, "a long, b long")
        gone = {r.id for r in graph.first_come(df, kept, fold).collect()}
        want = set()
        for i in sorted({x for p in pairs for x in p}):
            if any(b == i and a not in want for a, b in pairs):
                want.add(i)
        assert gone == want


def test_a_long_chain_takes_few_jobs(spark):
    chain = spark.range(4_999).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    gone = sorted(r.id for r in graph.first_come(chain, Kept(spark, "chain")).collect())
    jobs_run = len(tracker.getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("", "")
    assert gone == list(range(1, 5_000, 2)) and jobs_run < 300


def test_a_repeated_headline_is_one_class(spark):
    """Pairs of classes stay as they are, however often a headline returns on its day."""
    def of(copies):
        rows = [(10 * k + c, "p", f"company number {k} reports record profit this quarter again", k) for k in range(6) for c in range(copies)]
        classes, pairs = dedup.near_dup_classes(dedup.headline_keys(stories(spark, rows)))
        return {r["class"] for r in classes.collect()}, sorted((r.a, r.b) for r in pairs.collect()), classes.count()

    one, many = of(1), of(9)
    assert one[0] == many[0] == {10 * k for k in range(6)} and one[1] == many[1] and (one[2], many[2]) == (6, 54)


def brute_survivors(spark, batch, stored):
    keys = {r.id: r for r in dedup.headline_keys(batch.unionByName(stored)).collect()}

    def same(a, b):
        x, y = keys[a], keys[b]
        if x.panel is None or x.panel != y.panel or not x.date or not y.date or abs((x.date - y.date).days) > 2 or not x.shingles or not y.shingles:
            return False
        s, t, n, m = set(x.shingles), set(y.shingles), set(x.numbers), set(y.numbers)
        if n and m and len(n & m) / len(n | m) < 0.5:
            return False
        i = len(s & t)
        return i / len(s | t) >= 0.5 or (i / min(len(s), len(t)) >= 0.62 and min(len(x.norm), len(y.norm)) >= 20)

    old = [r.id for r in stored.collect()]
    stays = []
    for i in sorted(r.id for r in batch.collect()):
        if not any(same(i, o) for o in old) and not any(same(i, k) for k in stays):
            stays.append(i)
    return stays


def test_survivors_against_a_loop(spark, sf):
    n = news(spark, sf, 12).select("id", "panel", "title", "date", "source_label")
    batch, stored = n.where("id % 3 <> 0"), n.where("id % 3 = 0")
    got = sorted(r.id for r in dedup.drop_near_dups(batch, stored).collect())
    assert got == brute_survivors(spark, batch, stored) and 0 < len(got) < batch.count()


def scanned(df):
    """Files that a scan without exchanges opens, and its partition filters."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().apply(0).metrics().apply("numFiles").value(), plan.toString().split("PartitionFilters: [")[1].split("]")[0]


# --- curation ---------------------------------------------------------------------------------------------------


def test_curation_reads_its_window_and_replays_add_nothing(spark, sf, tmp_path):
    base = str(tmp_path)
    n = news(spark, sf, 12).select("id", "panel", "title", "date", "source_label").where("panel is not null").withColumn("severity", F.lit("high")).withColumn("show_pin", F.lit(True))
    days = [n.where(F.col("date").between(f"2024-01-{a:02}", f"2024-01-{b:02}")).withColumn("panels", F.array("panel", F.lit("both"))).drop("panel") for a, b in ((1, 2), (3, 4), (9, 12))]
    schema, stored = days[0].schema, []

    def curate(checkpoint):
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        # Rows of all dates pass: the gate has a test of its own.
        jobs.curate(stream, f"{base}/out", f"{base}/log", "2024-01-12", checkpoint, hours=48, prepare=lambda b: b.withColumn("event", F.col("date")), capped="both").awaitTermination()

    import tallyroom.operators.feed as f

    real = f.recap_gate
    jobs.recap_gate = lambda df, today, hours=48: real(df, today, 24 * 30)
    try:
        for k, day in enumerate(days):
            day.coalesce(1).write.mode("append").parquet(f"{base}/in")
            curate(f"{base}/checkpoint")  # a new query each time: the store is all that is left of the last one
            stored.append(day)
        columns = ["id", "panel", "title", "date", "source_label"]
        out = spark.read.schema("id long, panel string, title string, date date, source_label string, severity string, show_pin boolean").parquet(f"{base}/out")
        before = sorted(map(tuple, out.select(*columns).collect()), key=repr)
        assert out.where("panel = 'both' and (severity <> 'medium' or show_pin)").isEmpty()
        # One batch after the other, each against what stayed: the same as a loop over panels.
        want, stays = [], {}
        for day in days:
            flat = day.withColumn("panel", F.explode("panels")).select(*columns)
            for panel in sorted(r[0] for r in flat.select("panel").distinct().collect()):
                mine = flat.where(F.col("panel") == panel)
                known = {text_hash for text_hash in stays.get(panel, {}).values()}
                hashed = mine.withColumn("h", text.title_hash(F.col("title"), F.col("source_label"))).collect()
                first = {}
                for r in sorted(hashed, key=lambda r: r.id):
                    if r.h not in known:
                        first.setdefault(r.h, r)
                batch = mine.where(F.col("id").isin([r.id for r in first.values()]))
                old = spark.createDataFrame(stays.get(panel, {}).keys(), mine.schema) if stays.get(panel) else mine.limit(0)
                fresh = brute_survivors(spark, batch, old.select(*columns))
                for r in first.values():
                    if r.id in fresh:
                        stays.setdefault(panel, {})[tuple(r)[:5]] = r.h
                        want.append(tuple(r)[:5])
        assert before == sorted(want, key=repr)
        log = {r.batch_id: r for r in spark.read.schema("batch_id long, rows_seen long, rows_added long, rows_stale long").parquet(f"{base}/log").collect()}
        assert sorted(log) == [0, 1, 2] and sum(r.rows_added for r in log.values()) == len(before) and log[0].rows_seen == 2 * days[0].count()
        # The last batch again: a checkpoint that has not seen its end.
        commits = tmp_path / "checkpoint" / "commits"
        for name in ("2", ".2.crc"):
            (commits / name).unlink(missing_ok=True)
        curate(f"{base}/checkpoint")
        assert sorted(map(tuple, spark.read.schema(out.schema).parquet(f"{base}/out").select(*columns).collect()), key=repr) == before
    finally:
        jobs.recap_gate = real
    # What the window of the third batch scans: no partition of the first two, none of another panel.
    schema = jobs.KEYS.format(id="struct<id: bigint, panel: string>")
    bucket = lambda d: (datetime.date(2024, 1, d) - datetime.date(1970, 1, 1)).days // 2
    window = jobs.stored_window(spark, f"{base}/out-keys", schema, [("both", bucket(9)), ("both", bucket(11))], 3)
    read, filters = scanned(window)
    stored = {r[0] for r in spark.read.schema(schema).parquet(f"{base}/out-keys").select(F.input_file_name()).distinct().collect()}
    mine = {x for x in stored if "panel=both" in x and int(x.split("bucket=")[1].split("/")[0]) >= bucket(9) - 1}
    assert 0 < read == len(mine) < len(stored) and "bucket#" in filters and "panel#" in filters


# --- claims -----------------------------------------------------------------------------------------------------

CLAIMS = "id long, panel string, url string, title string, date date"


def claim_rows(seed, n):
    rng = random.Random(seed)
    topics = ["alpha beta gamma", "delta epsilon zeta", "eta theta iota"]
    rows = [(i, rng.choice("pq"), rng.choice(["https://a.co/news/12345", "https://b.co/news/77777", "https://a.co/", None]), f"{rng.choice(topics)} no{rng.randrange(3)}", datetime.date(2024, 1, 1) + datetime.timedelta(days=i // 3)) for i in range(n)]
    return rows + [(n, None, "https://a.co/news/12345", "alpha beta", datetime.date(2024, 1, 2) + datetime.timedelta(days=n // 3)), (n + 1, "p", "https://a.co/news/12345", None, None)]


def brute_claims(rows, keep, story):
    owners, out = {}, {}
    for i, panel, url, title, date in sorted(rows, key=lambda r: (r[4] or datetime.date.min, r[0])):
        out[i] = url
        if url is None or url == "https://a.co/" or date is None or panel is None:
            continue
        owner = owners.get((panel, url))
        if owner is None or date > owner[1] + datetime.timedelta(days=keep):
            owners[panel, url] = (title, date)
        elif not story(title, owner[0]):
            out[i] = None
    return out


def _story(a, b):
    x, y = ([t for t in s.split() if len(t) >= 3] for s in (a, b))
    n = sum(t in y for t in x)
    return n >= 2 and n / min(len(x), len(y)) >= 0.6


def test_claims_in_order_against_a_loop(spark):
    rows = [r for r in claim_rows(1, 120) if r[1] is not None]
    out, owners = audits.claims_in_order(spark.createDataFrame(rows, CLAIMS), keep_days=7)
    assert {r.id: r.url_kept for r in out.collect()} == brute_claims(rows, 7, _story)
    assert owners.groupBy("panel", "url").count().where("count > 3").count() > 0  # claims ran out and were made anew


def test_claim_stream_equals_its_batch_twin(spark, tmp_path):
    """Three batches, each by a query of its own, one claim running out between them; a replay of the last adds nothing."""
    base = str(tmp_path)
    rows = [r for r in claim_rows(2, 150) if r[1] is not None and r[4] is not None]
    days = sorted({r[4] for r in rows})
    cuts = [days[0], days[14], days[30], days[-1] + datetime.timedelta(days=1)]
    run = lambda: jobs.claim_stream(spark.readStream.schema(CLAIMS).parquet(f"{base}/in"), f"{base}/claims", f"{base}/out", f"{base}/checkpoint", 7).awaitTermination()
    for a, b in zip(cuts, cuts[1:]):
        spark.createDataFrame([r for r in rows if a <= r[4] < b], CLAIMS).coalesce(1).write.mode("append").parquet(f"{base}/in")
        run()
    got = lambda: sorted((r.id, r.url_kept) for r in spark.read.schema("id long, url_kept string").parquet(f"{base}/out").collect())
    twin = audits.claims_in_order(spark.createDataFrame(rows, CLAIMS), keep_days=7)[0]
    first = got()
    assert first == sorted((r.id, r.url_kept) for r in twin.collect()) == sorted(brute_claims(rows, 7, _story).items())
    owners = spark.read.parquet(f"{base}/claims").count()
    for name in ("2", ".2.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    run()
    assert got() == first and spark.read.parquet(f"{base}/claims").count() == owners
    live = jobs.live_claims(spark, f"{base}/claims", ["p"], days[35], 9)
    read, filters = scanned(live)
    assert all(r.claimed_on >= days[35] for r in live.collect()) and not live.isEmpty()
    stored = spark.read.schema("claimed_on date, month string, panel string, batch long").parquet(f"{base}/claims")
    want = {r[0] for r in stored.where("panel = 'p' and month >= '2024-02'").select(F.input_file_name()).distinct().collect()}
    assert 0 < read == len(want) and "month#" in filters and "panel#" in filters
    assert jobs.expire_claims(spark, f"{base}/claims", days[35]) == 1
    left = spark.read.schema(stored.schema).parquet(f"{base}/claims")
    assert left.where("month < '2024-02'").isEmpty() and left.count() < owners


def test_rows_before_their_owner_are_held_against_it(spark):
    u = "https://a.co/news/12345"
    day = lambda d: datetime.date(2024, 1, d)
    first, owners = audits.claims_in_order(spark.createDataFrame([(1, "p", u, "alpha beta gamma", day(10))], CLAIMS))
    late, after = audits.claims_in_order(spark.createDataFrame([(2, "p", u, "delta epsilon zeta", day(5)), (3, "p", u, "alpha beta gamma new", day(9))], CLAIMS), owners)
    assert {r.id: r.url_kept for r in late.collect()} == {2: None, 3: u} and after.count() == 0


# --- publishers, relevance, pages -------------------------------------------------------------------------------


def test_publishers_by_their_deepest_host(spark):
    rows = [(1, "investor.assetwise.co.th"), (2, "WWW.bbc.com"), (3, "a.aio.panphol.com"), (4, "panphol.com"), (5, "localhost"), (6, None), (7, "notbbc.com")]
    got = {r.id: r.publisher for r in publishers.publisher_of(spark.createDataFrame(rows, "id int, host string"), publishers.alias_table(spark)).collect()}
    assert got == {1: "AssetWise", 2: "BBC", 3: "AiO", 4: None, 5: None, 6: None, 7: None}


def test_labels_against_the_whole_table(spark):
    rows = [
        (1, "กรุงเทพธุรกิจ on MSN", "https://www.msn.com/a/12345", "syndicated"),
        (2, "Money & Banking Magazine", "https://moneyandbanking.co.th/a/12345", "match"),
        (3, "NESDC / Thai PBS / GWA Asia", "https://www.thaipbs.or.th/a/12345", "match"),
        (4, "Bangkok Post", "https://siamrath.co.th/a/12345", "mismatch"),
        (5, "Somebody", "https://unknown.example/a/12345", "unknown"),
        (6, "** ธปท.", "https://www.bot.or.th/a/12345", "match"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "id int, source_label string, url string")
    got = {r.id: r.verdict for r in linkjobs.label_host_verdict(df, publishers.alias_table(spark), publishers.carrier_table(spark)).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_relevance(spark):
    rows = {
        "ASW จับมือ SCB ปล่อยสินเชื่อโครงการ": 50,  # a direct mention outweighs another sector's ticker
        "Global demand lifts Thai condo market": 0,
        "PTT ลงทุนคอนโด": 0,
        "คอนโดมิเนียม กรุงเทพ": 40,
        "bitcoin กับอสังหาฯ": 0,
        "BAYonne ltv": 25,
        "กนง. คงดอกเบี้ยนโยบาย": 40,
    }
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(rules.relevance_score(F.col("t"))).collect()]
    assert got == list(rows.values())
    assert spark.createDataFrame([(None,)], "t string").select(rules.relevance_score(F.col("t"), 7)).first()[0] == 7


def test_keyword_hits_equal_containment(spark):
    words = ["ab", "b", "คอนโด", "Éa", "", "abab"]
    titles = ["xabab", "ÉA", "", None, "คอนโดมิเนียม B"]
    rows = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    got = sorted((r.id, r.keyword) for r in feed.keyword_hits(rows, spark.createDataFrame([(w,) for w in words], "keyword string")).collect())
    assert got == sorted((i, w) for i, t in enumerate(titles) for w in words if w and w.lower() in (t or "").lower())


def walk(node, depth=0):
    if not node or depth > 6:
        return None
    if isinstance(node, list):
        return next((r for r in (walk(n, depth + 1) for n in node) if r), None)
    if not isinstance(node, dict):
        return None
    if isinstance(node.get("headline"), str) and node["headline"].strip():
        return node["headline"].strip()
    if isinstance(node.get("name"), str) and any(k in str(node.get("@type")) for k in ("Article", "BlogPosting")) and node["name"].strip():
        return node["name"].strip()
    return next((r for r in (walk(node.get(k), depth + 1) for k in feeds.LD_INNER) if r), None)


def test_json_ld_of_any_shape(spark):
    rng = random.Random(5)

    def node(depth):
        kind = rng.random()
        if depth > 8 or kind < 0.15:
            return rng.choice([1, "x", None, True, {"headline": rng.choice([" deep ", "", 3, "h"])}])
        if kind < 0.4:
            return [node(depth + 1) for _ in range(rng.randrange(4))]
        out = {k: node(depth + 1) for k in feeds.LD_INNER if rng.random() < 0.5}
        if rng.random() < 0.2:
            out |= {"@type": rng.choice(["NewsArticle", ["Thing", "BlogPosting"], "WebSite"]), "name": rng.choice(["named", 5, " "])}
        return out

    pages = [[node(0) for _ in range(rng.randrange(1, 3))] for _ in range(200)]
    html = [(i, "<html>" + "".join(f'<script type="application/ld+json">{json.dumps(b)}</script>' for b in p) + "<script type='application/ld+json'>{broken</script>") for i, p in enumerate(pages)]
    got = {r.id: r.t for r in spark.createDataFrame(html, "id int, html string").select("id", feeds.json_ld_headline(F.col("html")).alias("t")).collect()}
    want = {i: next((w for w in map(walk, p) if w), None) for i, p in enumerate(pages)}
    assert got == want and sum(w is not None for w in want.values()) > 50
    title = feeds.page_title(F.col("html"))
    row = spark.createDataFrame([('<script type="application/ld+json">[{"@graph":[{"headline":"A &amp; B"}]}]</script><title>t</title>',)], "html string").select(title["title"], title["origin"]).first()
    assert tuple(row) == ("A & B", "json_ld")


def test_longest_run_of_long_and_repetitive_titles(spark):
    rng = random.Random(9)
    a = "".join(rng.choice("abcdefgh") for _ in range(5_000))
    b = "".join(rng.choice("abcdefgh") for _ in range(3_000)) + a[2_000:3_777] + "zz"
    rows = [(1, a, b), (2, "ab" * 4_000 + "x", "ba" * 3_000 + "y"), (3, "abc", "xyz"), (4, None, "a"), (5, "a", "xya"), (6, "ก" * 700, "ก" * 650 + "a" + "ก" * 10)]
    got = {r.id: r.containment for r in audits.lcs_containment(spark.createDataFrame(rows, "id int, a string, b string")).collect()}
    assert got == pytest.approx({1: 1777 / 4_779, 2: 5_999 / 6_001, 3: 0, 4: 0, 5: 1, 6: 650 / 661}, abs=1e-3)


def test_repaired_records(spark):
    rows = [
        (1, "[Head line] SUMMARY: [a b\nc] URL: https://a.co/x/12345?utm_source=1#f, SOURCE: S", None, ""),
        (2, "Head SUMMARY: lost URL: https://a.co/x", "own", "https://own.co/1"),
        (3, "SUMMARY: nothing before", None, None),
        (4, "whole title", None, None),
        (5, None, None, None),
    ]
    got = {r.id: (r.title, r.summary, r.url, r.repaired) for r in feeds.repair_records(spark.createDataFrame(rows, "id int, title string, summary string, url string")).collect()}
    assert got[1] == ("Head line", "a b\nc", "https://a.co/x/12345", True) and got[2] == ("Head", "own", "https://own.co/1", True)
    assert got[3] == (rows[2][1], None, None, False) and got[4] == ("whole title", None, None, False) and got[5] == (None, None, None, False)


def test_stored_links_are_clean_and_canonical(spark):
    rows = {"HTTPS://A.co:443/x/?utm_source=1#f": "https://a.co/x", " https://a.co/a/b, https://c.co": "https://a.co/a/b", "NONE": "", "ftp://a.co/x": "", "https://a.co/Foo_(bar)": "https://a.co/Foo_(bar)", "https://a.co/x).": "https://a.co/x"}
    assert [r[0] for r in spark.createDataFrame([(k,) for k in rows], "u string").select(links.stored_url(F.col("u"))).collect()] == list(rows.values())
