import datetime
import json

from pyspark.sql import functions as F

from tallyroom.operators import prices
from tallyroom.plans.adapters import news, ticks
from tallyroom.sources import feeds
from tallyroom.streaming import jobs


def test_chart_payload(spark, tmp_path):
    payload = {"chart": {"result": [{"meta": {"symbol": "A"}, "timestamp": [1735689600, 1735776000, 1735862400], "indicators": {"quote": [{"close": [1.0, None, 3.0], "volume": [5, 6, None]}], "adjclose": [{"adjclose": [1.5, None, None]}]}}]}}
    (tmp_path / "a.json").write_text(json.dumps(payload))
    got = [(r.ticker, str(r.date), r.close, r.volume) for r in feeds.read_chart_json(spark, str(tmp_path)).orderBy("date").collect()]
    assert got == [("A", "2025-01-01", 1.5, 5.0), ("A", "2025-01-03", 3.0, 0.0)]


def test_feed_items(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        "<rss><channel><item><title><![CDATA[A &amp; B]]></title><link> https://a.co/1 </link><pubDate>Mon, 04 Aug 2025 10:00:00 GMT</pubDate><guid>1</guid><source>Paper</source></item>"
        "<item><title>C</title><link>https://a.co/2</link><guid>2</guid></item></channel></rss>"
    )
    got = [(r.title, r.link, str(r.published), r.source) for r in feeds.read_feed_xml(spark, str(tmp_path)).orderBy("guid").collect()]
    assert got == [("A & B", "https://a.co/1", "2025-08-04 10:00:00", "Paper"), ("C", "https://a.co/2", "None", None)]


def stream_of(spark, df, folder):
    df.repartition(3).write.parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_last_ticks_stream_equals_batch(spark, sf, tmp_path):
    t = ticks(spark, sf)
    query = jobs.last_ticks(stream_of(spark, t, tmp_path / "in"), prices.HOLIDAYS).writeStream.outputMode("complete").format("memory").queryName("last_ticks").start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted((r.symbol, r.price) for r in df.collect())
    assert key(spark.table("last_ticks")) == key(jobs.last_ticks(t, prices.HOLIDAYS)) != []


def test_fresh_ticks(spark):
    now = datetime.datetime(2026, 1, 2, 5, 0)
    rows = [(1, now - datetime.timedelta(hours=h)) for h in (1, 13, 23, 30)] + [(2, now + datetime.timedelta(hours=1))]
    got = [r.state for r in jobs.fresh_ticks(spark.createDataFrame(rows, "symbol int, ts timestamp"), now).collect()]
    assert got == ["live", "pending", "pending", "rejected", "rejected"]


def test_dedup_stream_equals_batch(spark, sf, tmp_path):
    n = news(spark, sf).select("panel", F.md5("title").alias("title_hash"), F.lit("2024-01-01").cast("timestamp").alias("event_ts"))
    n = n.union(n)
    query = jobs.dedup_stream(stream_of(spark, n, tmp_path / "in")).writeStream.format("memory").queryName("dedup").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("dedup").count() == n.select("panel", "title_hash").distinct().count()


def test_late_rows_are_routed(spark, sf, tmp_path):
    n = news(spark, sf).select("id", "date")
    counts = {"kept": 0, "stale": 0}
    sink = lambda k: lambda df, i: counts.__setitem__(k, counts[k] + df.count())
    query = jobs.route_late(stream_of(spark, n, tmp_path / "in"), "2024-06-30", sink("kept"), sink("stale"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert counts["kept"] + counts["stale"] == n.count() and counts["kept"] == n.where("date between '2024-06-28' and '2024-06-30'").count()


def test_curation_adds_no_near_copy_twice(spark, sf, tmp_path):
    n = news(spark, sf, 3).select("id", "panel", "title", "date", "source_label")
    target, log = str(tmp_path / "out"), str(tmp_path / "log")
    query = jobs.curate(stream_of(spark, n, tmp_path / "in"), target, log, "2024-01-03", str(tmp_path / "cp"))
    query.awaitTermination()
    from tallyroom.operators.dedup import headline_keys, near_dup_pairs

    out = spark.read.parquet(target)
    assert 0 < out.count() <= n.count() and near_dup_pairs(headline_keys(out)).count() == 0
    assert spark.read.parquet(log).agg(F.sum("rows_added")).first()[0] == out.count()
