"""Streaming forms of the feed and price jobs."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyroom.functions.dates import market_open
from tallyroom.functions.text import title_hash
from tallyroom.operators.feed import recap_gate
from tallyroom.operators.scratch import Kept, delete, exists


def last_ticks(ticks: DataFrame, holidays: list[str]) -> DataFrame:
    """Last price per symbol within market hours; ticks without a price leave the state alone. For update mode."""
    day = F.date_format(F.from_utc_timestamp("ts", "Asia/Bangkok"), "yyyy-MM-dd")
    live = ticks.where(F.col("price").isNotNull() & market_open(F.col("ts"), day.isin(holidays)))
    return live.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "id")).alias("price"), F.max("ts").alias("ts"))


def fresh_ticks(ticks: DataFrame, now, hours: int = 24) -> DataFrame:
    """state of each tick: live on the local day of now, pending on the day before within hours, else rejected."""
    zone = "Asia/Bangkok"
    local = lambda c: F.to_date(F.from_utc_timestamp(c, zone))
    at = F.lit(now).cast("timestamp")
    age = at.cast("double") - F.col("ts").cast("double")
    live = local(F.col("ts")) == local(at)
    return ticks.withColumn("state", F.when(live & (age >= 0), "live").when((F.datediff(local(at), local(F.col("ts"))) == 1) & (age <= hours * 3600), "pending").otherwise("rejected"))


def latest_quote(rows: DataFrame, now, hours: int = 24) -> DataFrame:
    """symbol, price, ts, source of rows (id, symbol, ts, price, kind): the last candle wins over any meta row, also one that came before it.

    A symbol without a candle has its last meta row: meta-fallback on the local day of now, meta-pending before it within hours; older
    ones count for nothing. Rows without a price are passed over. In a stream (update or complete mode) the state is one row per
    symbol, so that a late candle replaces a meta row, and a late meta row no candle.
    """
    at = F.lit(now).cast("timestamp")
    local = lambda c: F.to_date(F.from_utc_timestamp(c, "Asia/Bangkok"))
    age = at.cast("double") - F.col("ts").cast("timestamp").cast("double")
    source = F.when(F.col("kind") == "candle", "candle").when(local(F.col("ts")) == local(at), "meta-fallback").otherwise("meta-pending")
    good = rows.where(F.col("price").isNotNull() & ((F.col("kind") == "candle") | (age <= hours * 3600)))
    best = F.max_by(F.struct("price", "ts", source.alias("source")), F.struct(F.col("kind") == "candle", "ts", "id"))
    return good.groupBy("symbol").agg(best.alias("q")).select("symbol", "q.*")


def dedup_stream(news: DataFrame, lateness: str = "48 hours") -> DataFrame:
    """First row per panel and hash within the lateness bound; the sink's insert-if-absent covers what is older."""
    return news.withWatermark("event_ts", lateness).dropDuplicatesWithinWatermark(["panel", "title_hash"])


def route_late(news: DataFrame, today, on_time: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None], checkpoint: str, hours: int = 48) -> StreamingQuery:
    """Each micro-batch through the recap gate: kept rows to one sink, stale ones to the other, none vanish."""

    def run(batch: DataFrame, batch_id: int) -> None:
        gated = recap_gate(batch, today, hours).persist()
        on_time(gated.where("gate = 'kept'").drop("gate"), batch_id)
        late(gated.where("gate = 'stale'").drop("gate"), batch_id)
        gated.unpersist()

    return news.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What the keys of stored headlines hold, next to their partitions: panel, time bucket and batch.
KEYS = "id {id}, at long, chars int, n int, numbers array<long>, shingles array<long>, k1 long, k2 long, title_hash string, bucket long, panel string, batch long"


def _merge(df: DataFrame, path: str, *by: str) -> None:
    """Overwrites the partitions that df has rows for, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _bucket(seconds: int) -> Column:
    return F.floor(F.col("at") / max(seconds, 86_400))


def stored_window(spark: SparkSession, keys: str, schema: str, touched: list[tuple[str, int]], batch_id: int) -> DataFrame:
    """Keys stored by earlier batches in the panels and time buckets that a batch touches, and the buckets beside them: the scan
    is pruned to these partitions. touched: (panel, bucket)."""
    near = sorted({b + d for _, b in touched for d in (-1, 0, 1)})
    rows = spark.read.schema(schema).parquet(keys) if near and exists(spark, keys) else spark.createDataFrame([], schema)
    return rows.where(F.col("bucket").isin(near) & F.col("panel").isin(sorted({p for p, _ in touched})) & (F.col("batch") < batch_id))


def known_hashes(spark: SparkSession, keys: str, prefixes: list[str], batch_id: int) -> DataFrame:
    """(panel, title_hash) that earlier batches stored at any time, of the hash prefixes that a batch has."""
    schema, path = "panel string, title_hash string, prefix string, batch long", f"{keys}-hashes"
    rows = spark.read.schema(schema).parquet(path) if prefixes and exists(spark, path) else spark.createDataFrame([], schema)
    return rows.where(F.col("prefix").isin(prefixes) & (F.col("batch") < batch_id)).select("panel", "title_hash")


def curate(
    news: DataFrame, target: str, log: str, today, checkpoint: str, hours: int = 48, prepare: Callable[[DataFrame], DataFrame] | None = None, capped: str | None = None, seq: tuple[str, ...] = ("id",), keys: str | None = None
) -> StreamingQuery:
    """Micro-batches parsed, gated, fanned out to their panels, held against what is stored, and appended under target, one log row each.

    prepare parses a batch into rows (as sources.feeds.load_records does); rows with an array `panels` go to each of them (capped: the panel
    with capped severity). Of rows with one title hash in a panel the first ever stored stays; near copies are looked for in the batch
    and in the stored headlines within hours. seq names and orders the rows before they are fanned out.

    What a stored headline is compared by is kept in `keys` (target + '-keys' if not given), partitioned by time bucket and panel, and never
    computed again; a batch reads the partitions of its own window, and its hashes' partitions. A replayed batch sees
    what it saw first, and overwrites its own partitions, so that it adds nothing twice. Partitions gain a file per batch: compact them at rest.
    """
    from tallyroom.operators import dedup
    from tallyroom.operators.feed import expand_by_panel

    keys = keys or f"{target.rstrip('/')}-keys"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        kept = Kept(spark, "curate")
        seen = recap_gate(prepare(batch) if prepare else batch, today, hours)
        if "panels" in seen.columns:
            seen = expand_by_panel(seen, capped=capped)
        seen = kept.keep(seen)
        columns = [c for c in seen.columns if c != "gate"]
        rows = seen.where("gate = 'kept'").drop("gate").withColumn("_title_hash", title_hash(F.col("title"), F.col("source_label")))
        rows = rows.withColumn("_id", F.struct(*seq, "panel"))
        rows = kept.keep(rows.withColumn("_rn", F.row_number().over(Window.partitionBy("panel", "_title_hash").orderBy("_id"))).where("_rn = 1").drop("_rn"))
        prefix = F.substring("_title_hash", 1, 2)
        prefixes = sorted(r[0] for r in rows.select(prefix).distinct().collect())  # 256 at most
        known = known_hashes(spark, keys, prefixes, batch_id).select("panel", F.col("title_hash").alias("_title_hash"))
        rows = rows.join(known, ["panel", "_title_hash"], "left_anti")
        named = rows.withColumnRenamed("id", "_item").withColumnRenamed("_id", "id")
        own = kept.keep(dedup.story_rows(dedup.headline_keys(named)))
        bucket = _bucket(hours * 3600)
        touched = [(r[0], r[1]) for r in own.select("panel", bucket).distinct().collect()]  # panels times days of the gate
        schema = KEYS.format(id=own.schema["id"].dataType.simpleString())
        fresh = kept.keep(dedup.drop_against(named, stored_window(spark, keys, schema, touched, batch_id), hours))
        new = own.join(fresh.select("id", F.col("_title_hash").alias("title_hash")), "id").withColumns({"bucket": bucket, "batch": F.lit(batch_id)})
        _merge(new, keys, "bucket", "panel", "batch")
        hashes = fresh.select("panel", F.col("_title_hash").alias("title_hash"), prefix.alias("prefix"), F.lit(batch_id).alias("batch"))
        _merge(hashes, f"{keys}-hashes", "prefix", "batch")
        fresh.withColumn("id", F.col("_item") if "id" in columns else F.col("id")).select(*columns).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        counts = seen.agg(F.count(F.lit(1)), F.count_if(F.col("gate") == "stale")).first()
        entry = (batch_id, counts[0] - counts[1], fresh.count(), counts[1])
        spark.createDataFrame([entry], "batch_id long, rows_seen long, rows_added long, rows_stale long").coalesce(1).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        delete(spark, kept.base)

    return news.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_claims(spark: SparkSession, claims: str, panels: list[str], since, batch_id: int) -> DataFrame:
    """Owners that earlier batches stored for these panels on or after a day; other partitions are not read."""
    schema = "url string, id long, title string, claimed_on date, month string, panel string, batch long"
    rows = spark.read.schema(schema).parquet(claims) if panels and exists(spark, claims) else spark.createDataFrame([], schema)
    day = F.lit(since).cast("date")
    return rows.where(F.col("panel").isin(panels) & (F.col("month") >= str(since)[:7]) & (F.col("claimed_on") >= day) & (F.col("batch") < batch_id)).drop("batch", "month")


def claim_stream(news: DataFrame, claims: str, target: str, checkpoint: str, keep_days: int = 30) -> StreamingQuery:
    """Micro-batches of rows (id, panel, url, title, date) with url_kept, appended under target: operators.audits.claims_in_order over all batches.

    The owners of links are a table partitioned by month and panel. A batch reads the months that can still bind it, and adds its new
    owners under its own number; a replay reads what its first run read, and overwrites what that wrote. Batches come in date
    order; a row dated before its link's owner is held against that owner. expire_claims deletes the months that bind no more.
    """
    from tallyroom.operators.audits import claims_in_order

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = Kept(spark, "claims")
        rows = kept.keep(batch)
        first = rows.agg(F.min("date")).first()[0]
        panels = sorted(r[0] for r in rows.select("panel").where("panel is not null").distinct().collect())
        since = first - datetime.timedelta(days=keep_days) if first else None
        out, owners = claims_in_order(rows, live_claims(spark, claims, panels if first else [], since, batch_id), keep_days)
        owners = kept.keep(owners)
        out.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        _merge(owners.withColumns({"batch": F.lit(batch_id), "month": F.date_format("claimed_on", "yyyy-MM")}), claims, "month", "panel", "batch")
        delete(spark, kept.base)

    return news.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expire_claims(spark: SparkSession, claims: str, before) -> int:
    """Deletes the months that end before a date from a table of claims; how many there were."""
    path = spark._jvm.org.apache.hadoop.fs.Path(claims)
    months = [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    old = [m for m in months if m.startswith("month=") and m.removeprefix("month=") < str(before)[:7]]
    for month in old:
        delete(spark, f"{claims}/{month}")
    return len(old)
