"""Staged and keyed writers, sessions of events, quotes as a stream, summaries in two languages, crawl audits."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tallyroom.functions import dates, publishers, rules
from tallyroom.operators import dedup, linkjobs, prices, sinks, tables
from tallyroom.streaming import jobs

ROWS = "id long, k string, v string, note string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROWS)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_swap_keeps_the_old_table_until_the_new_one_is_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    first, second = rows(spark, (1, "a", "x", None)), rows(spark, (1, "a", "y", None), (2, "b", "z", None))
    assert sinks.swap_table(first, path) == 1
    table = lambda: got(spark.read.schema(ROWS).parquet(path))

    def no(staged):
        raise ValueError("not this one")

    with pytest.raises(ValueError):
        sinks.swap_table(second, path, no)
    assert table() == got(first)
    real, calls = sinks._rename, []

    def broken(s, a, b):
        calls.append(a)
        if len(calls) == 2:  # after the old table has left its place
            raise OSError("lost")
        real(s, a, b)

    monkeypatch.setattr(sinks, "_rename", broken)
    with pytest.raises(OSError):
        sinks.swap_table(second, path)
    monkeypatch.setattr(sinks, "_rename", real)
    assert table() == got(first) and [x for x in os.listdir(tmp_path) if not x.startswith(".")] == ["table"]
    os.rename(path, path + sinks.OLD)  # a driver that died between the two renames
    sinks.recover(spark, path)
    assert table() == got(first)
    own = spark.read.schema(ROWS).parquet(path)
    assert sinks.swap_table(own.unionByName(second.where("id = 2")), path) == 2 and len(table()) == 2  # reads what it replaces
    assert sinks.swap_table(first.limit(0), path) == 0 and table() == []


def stamps(path):
    return {d: {f: os.stat(os.path.join(path, d, f)).st_mtime_ns for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet")} for d in os.listdir(path) if d.startswith("bucket=")}


def test_keyed_writes_touch_their_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "keyed")
    table = sinks.KeyedTable(spark, path, ROWS, ["k"], 16)
    start = rows(spark, *((i, f"k{i}", "old", "note" if i % 2 else None) for i in range(60)))
    assert table.upsert(start) == (60, 0) and got(table.read()) == got(start)
    before = stamps(path)
    updates = rows(spark, (3, "k3", "new", None), (4, "k4", None, None), (99, "k99", "new", "n"))
    want = tables.upsert(start, updates, ["k"], ("note", "v")).select("id", "k", "v", "note")
    assert table.upsert(updates, ("note", "v")) == (1, 2) and got(table.read()) == got(want)
    touched = {f"bucket={r[0]}" for r in updates.select(sinks.bucket_of(["k"], 16)).collect()}
    after = stamps(path)
    assert {d for d in after if after[d] != before.get(d)} == touched and len(touched) < len(after)
    more = rows(spark, (7, "new1", "a", None), (5, "new1", "b", None), (1, "k3", "c", None))
    assert table.insert(more) == 1 and table.insert(more) == 0
    assert got(table.read().where("k = 'new1'")) == [(5, "new1", "b", None)] and got(table.read().where("k = 'k3'")) == [(3, "k3", "new", "note")]
    assert table.insert(more.limit(0)) == 0 and table.upsert(updates.limit(0)) == (0, 0)


def test_a_failed_keyed_write_leaves_the_old_rows(spark, tmp_path):
    table = sinks.KeyedTable(spark, str(tmp_path / "keyed"), ROWS, ["k"], 4)
    table.upsert(rows(spark, (1, "a", "old", None), (2, "b", "old", None)))
    bad = rows(spark, (1, "a", "new", None)).withColumn("v", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        table.upsert(bad)
    assert {r.v for r in table.read().collect()} == {"old"}


def event_rows(spark):
    day = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)
    values = [(1, "p", "f", "t", 0), (2, "p", "f", "longer", 0), (3, "p", "f", "t", 14), (4, "p", "f", "t", 29), (5, "q", "f", None, 3), (6, "p", None, "t", 3), (7, "p", "g", "t", 5), (8, "p", "g", "t", 60)]
    return spark.createDataFrame([(i, p, f, t, day(d)) for i, p, f, t, d in values], "id long, panel string, fingerprint string, title string, at timestamp")


SESSIONS = [("p", "f", 2, 3), ("p", "f", 4, 1), ("p", "g", 7, 1), ("p", "g", 8, 1), ("q", "f", 5, 1)]


def test_sessions_are_the_runs(spark):
    df = event_rows(spark)
    out = dedup.event_sessions(df.withColumn("date", F.col("at").cast("date")).drop("at"))
    assert sorted((r.panel, r.fingerprint, r.keep, r.n) for r in out.collect()) == SESSIONS
    runs = dedup.event_runs(df.withColumn("date", F.col("at").cast("date"))).groupBy("panel", "fingerprint", "run").count()
    assert runs.count() == len(SESSIONS)


def test_sessions_as_a_stream(spark, tmp_path):
    df = event_rows(spark)
    late = spark.createDataFrame([(99, "z", "end", "t", datetime.datetime(2025, 1, 1))], df.schema)  # moves the watermark past all others
    df.orderBy("at").coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: dedup.event_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("at", "1 day"), time="at").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    run()
    late.write.mode("append").parquet(str(tmp_path / "in"))
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.panel, r.fingerprint, r.keep, r.n) for r in out.collect()) == SESSIONS


def test_quotes_prefer_candles_in_batch_and_stream(spark, tmp_path):
    now = datetime.datetime(2024, 1, 20, 5)
    at = lambda h: now - datetime.timedelta(hours=h)
    values = [(1, "a", at(3), 1.0, "candle"), (2, "a", at(1), 9.0, "meta"), (3, "b", at(2), 2.0, "meta"), (4, "c", at(20), 3.0, "meta"), (5, "d", at(30), 4.0, "meta"), (6, "e", at(40), 5.0, "candle"), (7, "b", at(1), None, "candle")]
    df = spark.createDataFrame(values, "id long, symbol string, ts timestamp, price double, kind string")
    want = [("a", 1.0, "candle"), ("b", 2.0, "meta-fallback"), ("c", 3.0, "meta-pending"), ("e", 5.0, "candle")]
    key = lambda out: sorted((r.symbol, r.price, r.source) for r in out.collect())
    assert key(jobs.latest_quote(df, now)) == want
    for part in ("id > 1", "id = 1"):  # the candle comes last
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.latest_quote(stream, now).writeStream.outputMode("complete").format("memory").queryName("quotes").start()
    query.processAllAvailable()
    query.stop()
    assert key(spark.table("quotes")) == want


def test_summaries_in_two_languages(spark):
    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=i)
    values = [("a", day(i), 100.0 + i, 10.0, 100.0, None, 0.0) for i in range(40)]
    values += [("a", day(40), 150.0, 900.0, 100.0, "กนง. ขึ้นดอกเบี้ย", 7.91), ("b", day(0), None, 1.0, 100.0, None, 0.0), ("c", day(0), 5.0, 1.0, None, None, 0.0)]
    df = spark.createDataFrame(values, "ticker string, date date, close double, volume double, idx double, remark string, change double")
    en = {r.ticker: list(r.bullets) for r in prices.rule_summary(df, "en").collect()}
    th = {r.ticker: list(r.bullets) for r in prices.rule_summary(df).collect()}
    assert en["a"][0] == "Closed up 7.91% from prior session" and en["a"][1].startswith("Volume surged 23.") and en["a"][2] == "Biggest event impact: กนง. ขึ้นดอกเบี้ย"
    assert en["a"][3:] == ["Price at 100% of 52W range", "Key events in range: Interest rate ×1"]
    assert en["b"] == ["No data in selected range"] and en["c"] == ["No classifiable events in range"]
    assert th["a"][0] == "ราคาปิดบวก 7.91% จากก่อนหน้า" and th["a"][4] == "เหตุการณ์หลักในช่วง: ดอกเบี้ย ×1" and th["b"] == ["ไม่มีข้อมูลในช่วงที่เลือก"]


def test_item_dates_levels_and_remark_columns(spark):
    texts = {"2024-05": datetime.date(2024, 5, 15), "[2024-05-02]": datetime.date(2024, 5, 2), "2024": None, "2024-13": None, None: None, "2024-05-02 x": None}
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(dates.item_date(F.col("t"))).collect()] == list(texts.values())
    levels = [(None, "HIGH", "high", "HIGH"), ("low", None, "low", "LOW"), (None, None, "medium", "MEDIUM"), (None, "odd", "medium", "odd"), ("high", "LOW", "high", "LOW")]
    x = rules.filled_levels(F.col("s"), F.col("l"))
    assert [tuple(r) for r in spark.createDataFrame([v[:2] for v in levels], "s string, l string").select(x["severity"], x["impact_level"]).collect()] == [v[2:] for v in levels]
    c = rules.remark_columns(F.col("t"))
    assert [tuple(r) for r in spark.createDataFrame([("กนง.",), ("คอนโด",), ("unknown words",), (" ",)], "t string").select(c["company"], c["sector"], c["macro"]).collect()] == [(None, None, "กนง."), (None, "คอนโด", None), ("unknown words", None, None), (None, None, None)]


def test_crawl_audit(spark):
    ok = "https://www.bangkokpost.com/news/12345"
    values = [
        (1, 200, None, ok, "Rates up | Bangkok Post", "Rates up", "Bangkok Post", "valid"),
        (2, 404, None, ok, "x", "Rates up", "Bangkok Post", "dead"),
        (3, 200, None, ok, "Rates up | Bangkok Post", "Rates up", "สยามรัฐ", "mismatch"),
        (4, 200, None, ok, "Bangkok Post", "Rates up", "Bangkok Post", "title_unknown"),
        (5, 200, None, ok, "ผลฟุตบอลเมื่อคืน", "zzqq jjkk", "Bangkok Post", "title_mismatch_high"),
        (6, None, "timeout", ok, None, None, None, "timeout"),
        (7, 200, None, "https://unlisted.example/news/12345", "Rates up today", "Rates up", "Anyone", "valid"),
        (8, 200, None, ok, None, None, None, "title_unknown"),
    ]
    df = spark.createDataFrame([v[:7] for v in values], "id int, status int, error string, final_url string, page_title string, headline string, source_label string")
    out = {r.id: r.verdict for r in linkjobs.crawl_audit(df, publishers.alias_table(spark), publishers.carrier_table(spark)).collect()}
    assert out == {v[0]: v[7] for v in values}
