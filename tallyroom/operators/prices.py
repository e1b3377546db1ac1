"""Price series: returns, baskets, chained indices, as-of joins, calendars and rule figures.

Bars are long: (ticker, date, close, volume), one row per ticker and date. Windows are partitioned by ticker, so that
a universe of any size spreads over the cluster; a per-date series of one basket is as long as its calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Holidays of the exchange whose calendar the panels follow, 2025 and 2026.
HOLIDAYS = [
    "2025-01-01", "2025-02-12", "2025-04-07", "2025-04-14", "2025-04-15", "2025-04-16", "2025-05-01", "2025-05-05",
    "2025-05-12", "2025-06-02", "2025-07-28", "2025-07-29", "2025-08-11", "2025-08-12", "2025-10-23", "2025-12-05",
    "2025-12-10", "2025-12-31", "2026-01-01", "2026-02-12", "2026-04-06", "2026-04-13", "2026-04-14", "2026-04-15",
    "2026-05-01", "2026-05-04", "2026-05-11", "2026-06-01", "2026-07-28", "2026-07-29", "2026-08-10", "2026-08-11",
    "2026-10-23", "2026-12-07", "2026-12-10", "2026-12-31",
]


def _by(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("date")


def percent(now: Column, before: Column) -> Column:
    """Change in percent; null where the base is null or 0."""
    return F.try_divide(now - before, before) * 100


def rounded_percent(now: Column, before: Column) -> Column:
    """percent to four decimals, halves away from zero, of prices in whole millionths: no half hangs on the last bit of a quotient of doubles."""
    p, c = (F.round(x * 1_000_000).cast("long").cast("decimal(20,0)") for x in (now, before))
    n, d = F.abs(p - c) * 2_000_000 + F.abs(c), F.abs(F.nullif(c, F.lit(0))) * 2
    size = (n - n % d) / d
    return F.when((p < c) == (c < 0), size).otherwise(-size).cast("double") / 10_000


def pct_change(df: DataFrame, key: str = "ticker") -> DataFrame:
    """change: percent against the row right before, rounded to 4; null if that row has no close."""
    return df.withColumn("change", F.round(percent(F.col("close"), F.lag("close").over(_by(key))), 4))


def peer_change(bars: DataFrame) -> DataFrame:
    """Unrounded change of priced rows; a null close resets the previous value and then drops out."""
    return bars.withColumn("change", percent(F.col("close"), F.lag("close").over(_by("ticker")))).where("close is not null")


def basket_returns(bars: DataFrame, min_members: int | None = None) -> DataFrame:
    """date, ret, members: mean return of the tickers that have a bar that day and one before.

    With min_members null all tickers with two bars or more must be there.
    """
    bars = bars.where("close is not null")
    returns = bars.withColumn("r", F.try_divide("close", F.lag("close").over(_by("ticker"))) - 1).where("r is not null")
    daily = returns.groupBy("date").agg(F.avg("r").alias("ret"), F.count(F.lit(1)).alias("members"))
    if min_members is not None:
        return daily.where(F.col("members") >= min_members)
    universe = returns.agg(F.countDistinct("ticker").alias("universe"))
    return daily.join(F.broadcast(universe), F.col("members") == F.col("universe")).drop("universe")


def chain_index(returns: DataFrame, base: float = 100.0) -> DataFrame:
    """date, level: base times the running product of 1 + ret; rounded on output alone."""
    running = F.product(1 + F.col("ret")).over(Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return returns.select("date", F.round(F.lit(base) * running, 4).alias("level"))


def back_chain(returns: DataFrame, anchor_date, anchor_level: float, floor: float = -0.95) -> DataFrame:
    """Levels before the anchor, walking back: level / (1 + ret of the later day); null or extreme returns are skipped."""
    usable = F.when(F.col("ret").isNull() | (F.col("ret") <= floor), 1.0).otherwise(1 + F.col("ret"))
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    rows = returns.where(F.col("date") <= F.lit(anchor_date))
    return rows.select("date", (F.lit(anchor_level) / F.coalesce(F.product(usable).over(later), F.lit(1.0))).alias("level"))


def join_series(bars: DataFrame, idx: DataFrame, sector: DataFrame) -> DataFrame:
    """ticker, date, close, idx, sector on the union of each ticker's dates with those of both series."""
    spine = date_spine(bars, idx, sector.select("date")).join(F.broadcast(bars.select("ticker").distinct()))
    out = spine.join(bars.select("ticker", "date", "close", "volume"), ["ticker", "date"], "left")
    return out.join(idx.select("date", F.col("close").alias("idx")), "date", "left").join(sector.select("date", F.col("level").alias("sector")), "date", "left")


def date_spine(*series: DataFrame) -> DataFrame:
    """Distinct dates over all series."""
    out = series[0].select("date")
    for s in series[1:]:
        out = out.union(s.select("date"))
    return out.distinct()


def common_dates(bars: DataFrame) -> DataFrame:
    """Dates that every ticker has: an n-way intersection in one aggregation."""
    n = bars.agg(F.countDistinct("ticker").alias("n"))
    return bars.groupBy("date").agg(F.countDistinct("ticker").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("date")


def asof_close(queries: DataFrame, bars: DataFrame) -> DataFrame:
    """For each (ticker, date) asked for, the latest close strictly before it and its date; null if there is none.

    Questions and bars are one union ordered by time, so that nothing but the ticker is shuffled on.
    """
    q = queries.select("ticker", "date", F.lit(0).alias("kind"), F.lit(None).cast("struct<close:double,date:date>").alias("bar"))
    b = bars.where("close is not null").select("ticker", "date", F.lit(1).alias("kind"), F.struct(F.col("close").cast("double").alias("close"), F.col("date").alias("date")).alias("bar"))
    before = Window.partitionBy("ticker").orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, 0)
    out = q.union(b).withColumn("bar", F.last("bar", ignorenulls=True).over(before)).where("kind = 0")
    return out.select("ticker", "date", F.col("bar.close").alias("asof_close"), F.col("bar.date").alias("asof_date"))


def attach_index(rows: DataFrame, idx: DataFrame) -> DataFrame:
    """rows with the index level of their date."""
    return rows.join(idx.select("date", F.col("close").alias("idx")), "date", "left")


def rescale_to_stored(points: DataFrame, stored: DataFrame, by: str | None = None) -> DataFrame:
    """points (date, close) times one factor that puts the earliest common date on its stored close; without a usable factor as they are.

    by: a column of points; each of its values has a factor of its own, also null's. stored has one row per date.
    """
    keys = [by] if by else []
    both = points.join(stored.select("date", F.col("close").alias("was")), "date")
    factor = both.where("close is not null and was is not null").groupBy(*(F.col(k).alias("_by") for k in keys)).agg(F.min_by(F.try_divide("was", "close"), "date").alias("f"))
    good = F.when((F.col("f") > 0) & (F.col("f") < float("inf")), F.col("f")).otherwise(1.0)
    joined = points.join(factor, F.col(by).eqNullSafe(F.col("_by")), "left") if by else points.join(F.broadcast(factor))  # one row
    return joined.select(*keys, "date", (F.col("close") * good).alias("close"))


def volume_surge(bars: DataFrame, rows: int = 31, times: float = 2.0) -> DataFrame:
    """Last priced row of each ticker: whether its volume is over times the mean of the last rows, itself included."""
    w = _by("ticker").rowsBetween(-(rows - 1), 0)
    out = bars.where("close is not null").withColumn("mean_volume", F.avg(F.coalesce("volume", F.lit(0))).over(w))
    return last_rows(out).select("ticker", "date", "volume", F.round("mean_volume", 6).alias("mean_volume"), ((F.col("mean_volume") > 0) & (F.col("volume") > times * F.col("mean_volume"))).alias("surge"))


def last_rows(df: DataFrame, key: str = "ticker") -> DataFrame:
    """The latest row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("date")))).where("_rn = 1").drop("_rn")


def range_position(bars: DataFrame, rows: int = 252) -> DataFrame:
    """Where the last close of each ticker stands between the lowest and highest of the last rows, in percent; null if these are equal."""
    w = _by("ticker").rowsBetween(-(rows - 1), 0)
    out = bars.where("close is not null").withColumns({"lo": F.min("close").over(w), "hi": F.max("close").over(w)})
    return last_rows(out).select("ticker", "date", "lo", "hi", F.round(F.when(F.col("hi") > F.col("lo"), (F.col("close") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 100), 6).alias("position"))


def event_impact(rows: DataFrame) -> DataFrame:
    """Of each ticker's rows with a remark and an index level, the one whose change differs most from the index's.

    rows: ticker, date, close, change, idx, remark. A missing or zero index level counts as no index change.
    """
    priced = rows.where("close is not null").withColumn("before", F.lag("idx").over(_by("ticker")))
    market = F.when((F.col("before") != 0) & (F.col("idx") != 0), percent(F.col("idx"), F.col("before"))).otherwise(0.0)
    impact = priced.where("remark is not null and remark <> '' and idx is not null").withColumn("impact", F.abs(F.coalesce("change", F.lit(0.0)) - F.coalesce(market, F.lit(0.0))))
    first = Window.partitionBy("ticker").orderBy(F.desc("impact"), "date")
    return impact.withColumn("_rn", F.row_number().over(first)).where("_rn = 1 and impact > 0").select("ticker", "date", "remark", F.round("impact", 4).alias("impact"))


def big_day(rows: DataFrame, least: float = 2.0) -> DataFrame:
    """Last priced row of each ticker with its change, and whether that is large either way."""
    return last_rows(rows.where("close is not null")).select("ticker", "date", "change", F.coalesce(F.abs("change") >= least, F.lit(False)).alias("big"))


#: Texts of the rule summary's lines in two languages, and what the event classes are called in them.
SUMMARY = {
    "th": {
        "up": "ราคาปิดบวก %.2f%% จากก่อนหน้า",
        "down": "ราคาปิดลบ %.2f%% จากก่อนหน้า",
        "volume": "ปริมาณซื้อขายพุ่ง %.2f เท่าของค่าเฉลี่ย 30 วัน",
        "event": "เหตุการณ์ที่มีผลกระทบมากที่สุด: %s",
        "range": "ราคาอยู่ที่ %.0f%% ของ 52W range",
        "wins": "เหตุการณ์หลักในช่วง: %s ×%d",
        "none": "ไม่พบเหตุการณ์ที่จัดประเภทได้ในช่วงนี้",
        "no_data": "ไม่มีข้อมูลในช่วงที่เลือก",
        "labels": {"interest": "ดอกเบี้ย", "presale": "Presale", "earnings": "ผลประกอบการ", "project": "โครงการ", "political": "การเมือง"},
    },
    "en": {
        "up": "Closed up %.2f%% from prior session",
        "down": "Closed down %.2f%% from prior session",
        "volume": "Volume surged %.2f× the 30-day average",
        "event": "Biggest event impact: %s",
        "range": "Price at %.0f%% of 52W range",
        "wins": "Key events in range: %s ×%d",
        "none": "No classifiable events in range",
        "no_data": "No data in selected range",
        "labels": {"interest": "Interest rate", "presale": "Presale", "earnings": "Earnings", "project": "Project", "political": "Political"},
    },
}


def rule_summary(rows: DataFrame, lang: str = "th") -> DataFrame:
    """ticker, bullets: the lines of the rules that fire, in order, five at most, in Thai or English (any other lang: Thai).

    rows: ticker, date, close, change, volume, idx, remark. Tickers without any price have the line that says so.
    """
    from tallyroom.operators.feed import top_event_type

    t = SUMMARY.get(lang, SUMMARY["th"])
    priced = rows.where("close is not null")
    change = F.col("change").cast("double")
    label = F.coalesce(*(F.when(F.col("event") == k, v) for k, v in t["labels"].items()), F.col("event"))
    out = rows.groupBy("ticker").agg(F.bool_or(F.col("close").isNotNull()).alias("priced"))
    parts = [
        big_day(rows).where("big").select("ticker", F.when(change > 0, F.format_string(t["up"], change)).otherwise(F.format_string(t["down"], F.abs(change))).alias("big")),
        volume_surge(rows).where("surge").select("ticker", F.format_string(t["volume"], F.col("volume") / F.col("mean_volume")).alias("volume")),
        event_impact(rows).select("ticker", F.format_string(t["event"], "remark").alias("event")),
        range_position(rows).where("position is not null").select("ticker", F.format_string(t["range"], "position").alias("range")),
        top_event_type(priced).select("ticker", F.format_string(t["wins"], label, "n").alias("wins")),
    ]
    for part in parts:
        out = out.join(part, "ticker", "left")
    lines = F.filter(F.array("big", "volume", "event", "range", "wins"), lambda x: x.isNotNull())
    bullets = F.when(~F.col("priced"), F.array(F.lit(t["no_data"]))).when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(t["none"])))
    return out.select("ticker", bullets.alias("bullets"))


def latest_per_key(bars: DataFrame) -> DataFrame:
    """Latest priced row per ticker, with the newest date of all alongside."""
    priced = bars.where("close is not null")
    latest = priced.groupBy("ticker").agg(F.max_by(F.struct("date", "close", "volume"), "date").alias("r")).select("ticker", "r.*")
    return latest.join(F.broadcast(priced.agg(F.max("date").alias("newest"))))


def boundary_change(old: DataFrame, prepended: DataFrame) -> DataFrame:
    """old and prepended rows; of the former first row of each ticker a null change is computed, all others stay."""
    first = old.groupBy("ticker").agg(F.min("date").alias("first_date"))
    both = old.unionByName(prepended, allowMissingColumns=True).withColumn("computed", F.round(percent(F.col("close"), F.lag("close").over(_by("ticker"))), 4))
    fix = (F.col("date") == F.col("first_date")) & F.col("change").isNull()
    return both.join(first, "ticker", "left").withColumn("change", F.when(fix, F.col("computed")).otherwise(F.col("change"))).drop("first_date", "computed")


def extend_history(bars: DataFrame, stored: DataFrame, idx: DataFrame) -> DataFrame:
    """Bars strictly before a ticker's first stored date, their change inside the gap, index level attached, sector left null."""
    first = stored.groupBy("ticker").agg(F.min("date").alias("first_date"))
    gap = bars.join(first, "ticker").where("date < first_date").drop("first_date")
    return attach_index(pct_change(gap), idx).withColumn("sector", F.lit(None).cast("double"))


def fetch_windows(panels: DataFrame, daily: DataFrame, overlap: int = 7) -> DataFrame:
    """Per panel (ticker, ipo_date) where to fetch from: its last date less overlap days, else its IPO; and the shared start, null if one has none."""
    last = daily.groupBy("ticker").agg(F.max("date").alias("last_date"))
    out = panels.join(last, "ticker", "left").select("ticker", F.coalesce(F.date_sub("last_date", overlap), "ipo_date").alias("since"))
    shared = out.agg(F.when(F.bool_or(F.col("since").isNull()), None).otherwise(F.min("since")).alias("shared_since"))
    return out.join(F.broadcast(shared))


# --- calendar --------------------------------------------------------------------------------------------------


def holidays(spark) -> DataFrame:
    return spark.createDataFrame([(d,) for d in HOLIDAYS], "date string").select(F.to_date("date").alias("date"))


def with_day_label(dates: DataFrame, days_off: DataFrame, col: str = "date") -> DataFrame:
    """label: weekend, holiday, or gap (a trading day)."""
    off = F.broadcast(days_off.select(F.col("date").alias("_off")).distinct())
    label = F.when(F.dayofweek(col).isin(1, 7), "weekend").when(F.col("_off").isNotNull(), "holiday").otherwise("gap")
    return dates.join(off, F.col(col) == F.col("_off"), "left").withColumn("label", label).drop("_off")


def calendar_days(spans: DataFrame) -> DataFrame:
    """One row per key and day of (key..., first, last); none where first is after last."""
    return spans.where("first <= last").withColumn("date", F.explode(F.sequence("first", "last"))).drop("first", "last")


def expected_days(spans: DataFrame, days_off: DataFrame) -> DataFrame:
    """Trading days of each span."""
    return with_day_label(calendar_days(spans), days_off).where("label = 'gap'").drop("label")


def missing_days(bars: DataFrame, days_off: DataFrame) -> DataFrame:
    """Days between a ticker's first and last that it has no row for, each with its label."""
    spans = bars.groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return with_day_label(calendar_days(spans).join(bars.select("ticker", "date"), ["ticker", "date"], "left_anti"), days_off)


def intraday_kpi(ticks: DataFrame, settled: DataFrame, key: str = "symbol") -> DataFrame:
    """Latest priced tick per key, the close before its day, and the change in percent, null where that close is null or 0. Keys without a price have nulls."""
    live = ticks.groupBy(key).agg(F.expr("max_by(struct(price, ts), struct(ts, id)) filter (where price is not null)").alias("t"))
    live = live.select(F.col(key).alias("ticker"), F.col("t.price").alias("price"), F.to_date("t.ts").alias("date"))
    asof = asof_close(live.select("ticker", "date"), settled)
    return live.join(asof, ["ticker", "date"], "left").select("ticker", "date", "price", "asof_close", rounded_percent(F.col("price"), F.col("asof_close")).alias("change"))
