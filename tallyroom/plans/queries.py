"""The registered queries, each next to the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.functions import classify, dates, links, rules, text
from tallyroom.operators import dedup, feed, prices, tables
from tallyroom.plans import rule_sql
from tallyroom.plans.adapters import bars, crawl, index, news, runs, ticks, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(views: str | None = None, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(views, sql) if views else sql
        return f

    return add


# --- prices ----------------------------------------------------------------------------------------------------

_RET = ", b AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM bars), d AS (SELECT date, avg(r) AS ret, count(r) AS members FROM b WHERE r IS NOT NULL GROUP BY date)"
_ALL = _RET + ", a AS (SELECT * FROM d WHERE members = (SELECT count(DISTINCT ticker) FROM b WHERE r IS NOT NULL))"


@register("bars", _ALL + " SELECT date, round(log10(round(100 * product(1 + ret) OVER (ORDER BY date), 4)), 6) AS log_level FROM a")
def sector_index(spark, sf):
    """The logarithm of the level: the given prices are so wild that levels reach 1e69."""
    return prices.chain_index(prices.basket_returns(bars(spark, sf))).select("date", F.round(F.log10("level"), 6).alias("log_level"))


@register("bars", _ALL + " SELECT date, round(ret, 8) AS ret, members FROM a")
def basket_returns_all(spark, sf):
    return prices.basket_returns(bars(spark, sf)).select("date", F.round("ret", 8).alias("ret"), "members")


@register("bars", _RET + " SELECT date, round(ret, 8) AS ret, members FROM d WHERE members >= 3")
def basket_returns_dynamic(spark, sf):
    return prices.basket_returns(bars(spark, sf), 3).select("date", F.round("ret", 8).alias("ret"), "members")


@register("bars", _RET + """ SELECT date, round(log10(50 / coalesce(product(CASE WHEN ret IS NULL OR ret <= -0.95 THEN 1 ELSE 1 + ret END)
    OVER (ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)), 4) AS log_level FROM d WHERE date <= DATE '1996-06-30'""")
def back_chained_index(spark, sf):
    return prices.back_chain(prices.basket_returns(bars(spark, sf), 1), "1996-06-30", 50.0).select("date", F.round(F.log10("level"), 4).alias("log_level"))


@register("bars", "SELECT ticker, date, close, volume, round((close - lag(close) OVER w) / lag(close) OVER w * 100, 4) AS change FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)")
def pct_change(spark, sf):
    return prices.pct_change(bars(spark, sf))


@register("bars", """ , n AS (SELECT ticker, date, CASE WHEN volume % 5 = 0 THEN NULL ELSE close END AS close FROM bars),
    c AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS p FROM n)
    SELECT ticker, date, close, round((close - p) / p * 100, 6) AS change FROM c WHERE close IS NOT NULL""")
def peer_change(spark, sf):
    rows = bars(spark, sf).select("ticker", "date", F.when(F.col("volume") % 5 == 0, None).otherwise(F.col("close")).alias("close"))
    return prices.peer_change(rows).withColumn("change", F.round("change", 6))


@register("bars idx", _ALL + """, s AS (SELECT date, round(100 * product(1 + ret) OVER (ORDER BY date), 4) AS level FROM a),
    spine AS (SELECT date FROM bars UNION SELECT date FROM idx UNION SELECT date FROM s)
    SELECT t.ticker, x.date, b0.close, b0.volume, i.close AS idx, round(log10(s.level), 6) AS log_sector FROM spine x CROSS JOIN (SELECT DISTINCT ticker FROM bars) t
    LEFT JOIN bars b0 ON b0.ticker = t.ticker AND b0.date = x.date LEFT JOIN idx i ON i.date = x.date LEFT JOIN s ON s.date = x.date""")
def joined_series(spark, sf):
    b = bars(spark, sf)
    out = prices.join_series(b, index(spark, sf), prices.chain_index(prices.basket_returns(b)))
    return out.withColumn("sector", F.round(F.log10("sector"), 6)).withColumnRenamed("sector", "log_sector")


@register("bars idx", "SELECT date FROM bars UNION SELECT date FROM idx")
def date_spine(spark, sf):
    return prices.date_spine(bars(spark, sf), index(spark, sf))


@register("bars", "SELECT date FROM bars GROUP BY date HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM bars)")
def common_dates(spark, sf):
    return prices.common_dates(bars(spark, sf))


@register("bars", """, q AS (SELECT ticker, date + 1 AS date FROM bars WHERE volume % 3 = 0)
    SELECT q.ticker, q.date, b.close AS asof_close, b.date AS asof_date FROM q ASOF LEFT JOIN bars b ON b.ticker = q.ticker AND q.date > b.date""")
def asof_close(spark, sf):
    b = bars(spark, sf)
    return prices.asof_close(b.where("volume % 3 = 0").select("ticker", F.date_add("date", 1).alias("date")), b)


@register("bars idx", "SELECT bars.*, idx.close AS idx FROM bars LEFT JOIN idx USING (date)")
def attach_index(spark, sf):
    return prices.attach_index(bars(spark, sf), index(spark, sf))


@register("bars idx", """, p AS (SELECT date, close FROM bars WHERE ticker = '1-URGENT'),
    f AS (SELECT arg_min(i.close / p.close, p.date) AS f FROM p JOIN idx i USING (date)) SELECT date, round(close * f, 6) AS close FROM p, f""")
def rescale_to_stored(spark, sf):
    points = bars(spark, sf).where("ticker = '1-URGENT'").select("date", "close")
    return prices.rescale_to_stored(points, index(spark, sf)).select("date", F.round("close", 6).alias("close"))


@register("bars", """, m AS (SELECT *, avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS mv, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM bars)
    SELECT ticker, date, volume, round(mv, 6) AS mean_volume, volume > 2 * mv AS surge FROM m WHERE rn = 1""")
def volume_surge(spark, sf):
    return prices.volume_surge(bars(spark, sf))


@register("bars", """, m AS (SELECT *, min(close) OVER w AS lo, max(close) OVER w AS hi, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM bars
    WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
    SELECT ticker, date, lo, hi, round((close - lo) / (hi - lo) * 100, 6) AS position FROM m WHERE rn = 1""")
def range_position(spark, sf):
    return prices.range_position(bars(spark, sf))


_REMARK = "CASE WHEN volume % 4 = 0 THEN 'remark ' || volume END"


@register("bars idx", f""", j AS (SELECT b.ticker, b.date, b.close, i.close AS idx, {_REMARK} AS remark, round((b.close - lag(b.close) OVER w) / lag(b.close) OVER w * 100, 4) AS change
        FROM bars b LEFT JOIN idx i USING (date) WINDOW w AS (PARTITION BY b.ticker ORDER BY b.date)),
    k AS (SELECT *, lag(idx) OVER (PARTITION BY ticker ORDER BY date) AS p FROM j),
    m AS (SELECT *, abs(coalesce(change, 0) - coalesce((idx - p) / p * 100, 0)) AS impact FROM k WHERE remark IS NOT NULL AND idx IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY impact DESC, date) AS rn FROM m)
    SELECT ticker, date, remark, round(impact, 4) AS impact FROM r WHERE rn = 1 AND impact > 0""")
def event_impact(spark, sf):
    rows = prices.attach_index(prices.pct_change(bars(spark, sf)), index(spark, sf))
    return prices.event_impact(rows.withColumn("remark", F.when(F.col("volume") % 4 == 0, F.concat(F.lit("remark "), F.col("volume")))))


@register("bars", """, c AS (SELECT *, round((close - lag(close) OVER w) / lag(close) OVER w * 100, 4) AS change, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))
    SELECT ticker, date, change, coalesce(abs(change) >= 2, false) AS big FROM c WHERE rn = 1""")
def big_day(spark, sf):
    return prices.big_day(prices.pct_change(bars(spark, sf)))


@register("bars", "SELECT ticker, max(date) AS date, arg_max(close, date) AS close, arg_max(volume, date) AS volume, (SELECT max(date) FROM bars) AS newest FROM bars GROUP BY ticker")
def latest_per_key(spark, sf):
    return prices.latest_per_key(bars(spark, sf))


@register("bars", """, o AS (SELECT *, NULL::DOUBLE AS change FROM bars WHERE date >= DATE '1996-01-01'), f AS (SELECT ticker, min(date) AS fd FROM o GROUP BY ticker),
    u AS (SELECT *, round((close - lag(close) OVER w) / lag(close) OVER w * 100, 4) AS comp FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))
    SELECT u.ticker, date, close, volume, CASE WHEN date = fd THEN comp END AS change FROM u LEFT JOIN f USING (ticker)""")
def boundary_change(spark, sf):
    b = bars(spark, sf)
    old = b.where("date >= date'1996-01-01'").withColumn("change", F.lit(None).cast("double"))
    return prices.boundary_change(old, b.where("date < date'1996-01-01'"))


@register("bars idx", """, g AS (SELECT * FROM bars WHERE date < DATE '1996-01-01')
    SELECT g.ticker, g.date, g.close, g.volume, round((g.close - lag(g.close) OVER w) / lag(g.close) OVER w * 100, 4) AS change, idx.close AS idx, NULL::DOUBLE AS sector
    FROM g LEFT JOIN idx USING (date) WHERE EXISTS (SELECT 1 FROM bars s WHERE s.ticker = g.ticker AND s.date >= DATE '1996-01-01') WINDOW w AS (PARTITION BY g.ticker ORDER BY g.date)""")
def extend_history(spark, sf):
    b = bars(spark, sf)
    first = b.where("date >= date'1996-01-01'").groupBy("ticker").agg(F.lit("1996-01-01").cast("date").alias("date"))
    return prices.extend_history(b, first, index(spark, sf))


@register("bars", "SELECT ticker, max(date) - 7 AS since, (SELECT min(m) FROM (SELECT max(date) - 7 AS m FROM bars GROUP BY ticker)) AS shared_since FROM bars GROUP BY ticker")
def fetch_windows(spark, sf):
    b = bars(spark, sf)
    return prices.fetch_windows(b.select("ticker").distinct().withColumn("ipo_date", F.lit("1990-01-01").cast("date")), b)


_HOLIDAYS = "h AS (SELECT CAST(unnest([" + ", ".join(f"'{d}'" for d in prices.HOLIDAYS) + "]) AS DATE) AS date)"
_LABEL = "CASE WHEN dayofweek(x.date) IN (0, 6) THEN 'weekend' WHEN h.date IS NOT NULL THEN 'holiday' ELSE 'gap' END"


@register("bars", f""", {_HOLIDAYS}, s AS (SELECT ticker, min(date) AS a, max(date) AS b FROM bars WHERE volume % 2 = 0 GROUP BY ticker),
    x AS (SELECT ticker, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM s)
    SELECT x.ticker, x.date, {_LABEL} AS label FROM x LEFT JOIN h ON h.date = x.date WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.volume % 2 = 0 AND b.ticker = x.ticker AND b.date = x.date)""")
def missing_days(spark, sf):
    return prices.missing_days(bars(spark, sf).where("volume % 2 = 0"), prices.holidays(spark))


@register("news", f""", {_HOLIDAYS}, s AS (SELECT panel, min(date) + 365 AS a, max(date) + 365 AS b FROM news GROUP BY panel),
    x AS (SELECT panel, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM s)
    SELECT x.panel, x.date FROM x LEFT JOIN h ON h.date = x.date WHERE {_LABEL} = 'gap'""")
def expected_days(spark, sf):
    spans = news(spark, sf).groupBy("panel").agg(F.date_add(F.min("date"), 365).alias("first"), F.date_add(F.max("date"), 365).alias("last"))
    return prices.expected_days(spans, prices.holidays(spark))


def _close():
    """The mean price to four decimals, halves up, of prices in millionths: integer sums are the same in any order, and no half is left to chance."""
    s, n = F.sum(F.round(F.col("price") * 1_000_000).cast("long")) + 50 * F.count("price"), 100 * F.count("price")
    return F.when(F.count("price") > 0, (s - F.pmod(s, n)) / n / 10_000)


@register("ticks", """, l AS (SELECT symbol, arg_max(price, (ts, id)) AS price, CAST(max(ts) FILTER (price IS NOT NULL) AS DATE) AS date FROM ticks GROUP BY symbol),
    u AS (SELECT symbol, CAST(ts AS DATE) AS date, sum(CAST(round(price * 1000000) AS BIGINT)) + 50 * count(price) AS s, 100 * count(price) AS n FROM ticks WHERE price IS NOT NULL GROUP BY ALL),
    s AS (SELECT symbol, date, CAST((s - (s % n + n) % n) // n AS HUGEINT) AS units FROM u),
    j AS (SELECT l.*, s.units / 10000 AS close, CAST(round(l.price * 1000000) AS HUGEINT) AS p, s.units * 100 AS c FROM l ASOF LEFT JOIN s ON s.symbol = l.symbol AND l.date > s.date)
    SELECT symbol AS ticker, date, price, close AS asof_close, CASE WHEN c <> 0 THEN CASE WHEN (p < c) = (c < 0) THEN 1 ELSE -1 END * ((abs(p - c) * 2000000 + abs(c)) // (2 * abs(c))) / 10000 END AS change FROM j""")
def intraday_kpi(spark, sf):
    t = ticks(spark, sf)
    settled = t.groupBy(F.col("symbol").alias("ticker"), F.to_date("ts").alias("date")).agg(_close().alias("close"))
    return prices.intraday_kpi(t, settled)


@register("ticks", f""", {_HOLIDAYS}, t AS (SELECT *, ts + INTERVAL 7 HOUR AS l FROM ticks)
    SELECT t.symbol, count(*) AS n, count(*) FILTER (dayofweek(l) NOT IN (0, 6) AND h.date IS NULL AND hour(l) * 60 + minute(l) BETWEEN 600 AND 1050) AS in_session FROM t LEFT JOIN h ON h.date = CAST(l AS DATE) GROUP BY ALL""")
def session_ticks(spark, sf):
    off = F.broadcast(prices.holidays(spark).select(F.col("date").alias("off")))
    t = ticks(spark, sf).withColumn("day", dates.local_date(F.col("ts"))).join(off, F.col("day") == F.col("off"), "left")
    return t.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(dates.market_open(F.col("ts"), F.col("off").isNotNull())).alias("in_session"))


# --- tables ----------------------------------------------------------------------------------------------------


@register("bars", "SELECT * FROM bars WHERE ticker = '1-URGENT' AND date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def scan_daily(spark, sf):
    return tables.scan_daily(bars(spark, sf), "1-URGENT", "1995-01-01", "1996-12-31")


_OLD = "o AS (SELECT ticker, date, close, volume, CASE WHEN volume % 2 = 0 THEN 'old' END AS remark FROM bars WHERE date < DATE '1997-01-01'), u AS (SELECT ticker, date, close + 1 AS close, volume, CASE WHEN volume % 3 = 0 THEN 'new' END AS remark FROM bars WHERE date >= DATE '1996-01-01')"


def _old_new(spark, sf):
    b = bars(spark, sf)
    old = b.where("date < date'1997-01-01'").withColumn("remark", F.when(F.col("volume") % 2 == 0, "old"))
    return old, b.where("date >= date'1996-01-01'").withColumn("close", F.col("close") + 1).withColumn("remark", F.when(F.col("volume") % 3 == 0, "new"))


@register("bars", f""", {_OLD} SELECT coalesce(o.ticker, u.ticker) AS ticker, coalesce(o.date, u.date) AS date, round(CASE WHEN u.ticker IS NULL THEN o.close ELSE u.close END, 4) AS close,
    CASE WHEN u.ticker IS NULL THEN o.volume ELSE u.volume END AS volume, coalesce(u.remark, o.remark) AS remark FROM o FULL JOIN u ON o.ticker = u.ticker AND o.date = u.date""")
def upsert_daily(spark, sf):
    return tables.upsert(*_old_new(spark, sf), ["ticker", "date"], ("remark",)).withColumn("close", F.round("close", 4))


@register("bars", f""", {_OLD} SELECT coalesce(o.ticker, u.ticker) AS ticker, coalesce(o.date, u.date) AS date, round(CASE WHEN u.ticker IS NULL THEN o.close ELSE u.close END, 4) AS close,
    CASE WHEN u.ticker IS NULL THEN o.volume ELSE u.volume END AS volume, CASE WHEN u.ticker IS NULL THEN o.remark ELSE u.remark END AS remark FROM o FULL JOIN u ON o.ticker = u.ticker AND o.date = u.date""")
def upsert_peers(spark, sf):
    return tables.upsert(*_old_new(spark, sf), ["ticker", "date"]).withColumn("close", F.round("close", 4))


@register("bars", f", {_OLD} SELECT u.ticker, count(*) FILTER (o.ticker IS NULL) AS added, count(*) FILTER (o.ticker IS NOT NULL) AS updated FROM u LEFT JOIN o USING (ticker, date) GROUP BY u.ticker")
def upsert_stats(spark, sf):
    return tables.upsert_stats(*_old_new(spark, sf), ["ticker", "date"], "ticker")


@register("bars", f""", {_OLD} SELECT o.ticker, o.date, round(CASE WHEN u.ticker IS NOT NULL AND o.volume > 2 THEN u.close ELSE o.close END, 4) AS close, o.volume, o.remark FROM o LEFT JOIN u USING (ticker, date)""")
def patch_column(spark, sf):
    old, new = _old_new(spark, sf)
    return tables.patch_column(old, new, ["ticker", "date"], "close", F.col("volume") > 2).withColumn("close", F.round("close", 4))


@register("bars", f""", {_OLD} SELECT o.ticker, o.date, o.close, o.volume, CASE WHEN u.remark IS NULL THEN o.remark WHEN o.remark IS NULL THEN u.remark ELSE o.remark || chr(10) || u.remark END AS remark,
    CASE WHEN u.ticker IS NOT NULL THEN 'COMPANY' END AS category FROM o LEFT JOIN u USING (ticker, date)""")
def append_remark(spark, sf):
    old, new = _old_new(spark, sf)
    return tables.append_remark(old.withColumn("category", F.lit(None).cast("string")), new.withColumn("category", F.lit("COMPANY")), ["ticker", "date"])


@register("bars", f""", {_HOLIDAYS}, o AS (SELECT * FROM bars WHERE volume % 2 = 0), k AS (SELECT ticker, date FROM bars WHERE volume % 2 = 1)
    SELECT * FROM o UNION ALL SELECT x.ticker, x.date, NULL, NULL FROM k x LEFT JOIN h ON h.date = x.date WHERE {_LABEL} = 'gap'""")
def ensure_rows(spark, sf):
    b = bars(spark, sf)
    return tables.ensure_rows(b.where("volume % 2 = 0"), b.where("volume % 2 = 1").select("ticker", "date"), prices.holidays(spark))


_NORM = r"trim(regexp_replace(regexp_replace(lower(regexp_replace(coalesce(title, ''), '\s+-\s+[^-\x{0E00}-\x{0E7F}]+$', '')), '[()\[\]{}\"''`.,!?;:]', '', 'g'), '\s+', ' ', 'g'), ' ')"
_HASH = f"sha1(coalesce(nullif({_NORM}, ''), coalesce(title, '') || coalesce(source_label, '')))"


@register("news", f""", h AS (SELECT *, {_HASH} AS title_hash FROM news), s AS (SELECT * FROM h WHERE id % 2 = 0), n AS (SELECT panel, title_hash, min(id) AS id FROM h WHERE id % 2 = 1 GROUP BY ALL)
    SELECT panel, title_hash, id FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.panel = n.panel AND s.title_hash = n.title_hash)""")
def insert_new(spark, sf):
    n = news(spark, sf).select("panel", text.title_hash(F.col("title"), F.col("source_label")).alias("title_hash"), "id")
    return tables.insert_new(n.where("id % 2 = 0"), n.where("id % 2 = 1"), ["panel", "title_hash"])


@register("news", f", h AS (SELECT id, {_HASH} AS title_hash FROM news) SELECT id, title_hash FROM h WHERE id % 2 = 1 AND title_hash NOT IN (SELECT title_hash FROM h WHERE id % 2 = 0)")
def skip_known(spark, sf):
    n = news(spark, sf).select("id", text.title_hash(F.col("title"), F.col("source_label")).alias("title_hash"))
    return tables.skip_known(n.where("id % 2 = 1"), n.where("id % 2 = 0"), ["title_hash"])


@register("runs", "SELECT id, started_at, ok, source, rows_added FROM runs WHERE id % 3 <> 2")
def append_runs(spark, sf):
    r = runs(spark, sf)
    return tables.append_runs(r.where("id % 3 = 0"), r.where("id % 3 <> 2"))


@register("news", "SELECT id, panel, title FROM news WHERE id % 7 <> 0")
def delete_rows(spark, sf):
    n = news(spark, sf)
    return tables.delete_rows(n, n.where("id % 7 = 0").select("id"))[0].select("id", "panel", "title")


@register("news", "SELECT id, hidden, 0::SMALLINT AS attempts, 'unchecked' AS status FROM news")
def ensure_columns(spark, sf):
    return tables.ensure_columns(news(spark, sf).select("id", "hidden"), {"hidden": ("boolean", False), "attempts": ("smallint", 0), "status": ("string", "unchecked")})


# --- feed ------------------------------------------------------------------------------------------------------


@register("news", "SELECT id, panel, category, date FROM news WHERE NOT hidden AND category = 'FX' AND date >= DATE '2024-03-01'")
def feed_filter(spark, sf):
    return feed.feed_filter(news(spark, sf), category="FX", since="2024-03-01").select("id", "panel", "category", "date")


@register("news", "SELECT id, date FROM news WHERE (coalesce(show_pin, false) OR chart_marked) AND date <= DATE '2024-09-30'")
def pin_filter(spark, sf):
    return feed.pin_filter(news(spark, sf), until="2024-09-30").select("id", "date")


@register("news", "SELECT id, coalesce(show_pin, severity = 'high') AS show_pin FROM news")
def default_pin(spark, sf):
    return feed.default_pin(news(spark, sf)).select("id", "show_pin")


@register("news", "SELECT id, coalesce(severity = 'high' AND NOT show_pin, false) AS repaired, CASE WHEN severity = 'high' AND NOT show_pin THEN true ELSE show_pin END AS show_pin FROM news")
def repair_pins(spark, sf):
    return feed.repair_pins(news(spark, sf)).select("id", "repaired", "show_pin")


@register("news", "SELECT id, date FROM news WHERE date >= DATE '2024-12-01' - 90")
def age_cutoff(spark, sf):
    return feed.age_cutoff(news(spark, sf), 90, "2024-12-01").select("id", "date")


@register("news", "SELECT id, CASE WHEN date IS NULL OR date BETWEEN DATE '2024-06-28' AND DATE '2024-06-30' THEN 'kept' ELSE 'stale' END AS gate FROM news")
def recap_gate(spark, sf):
    return feed.recap_gate(news(spark, sf), "2024-06-30").select("id", "gate")


_PLACEHOLDER = "(day(date) = 15 AND month(date) IN (2, 5, 6, 8, 11))"


@register("news", f"SELECT id, {_PLACEHOLDER} OR (month(date) = 6 AND day(date) = 1) OR date > DATE '2024-10-01' OR date < DATE '2000-01-01' AS fabricated, {_PLACEHOLDER} OR date > DATE '2024-10-01' OR date < DATE '2024-01-20' AS suspect FROM news")
def date_screens(spark, sf):
    d = F.col("date")
    return news(spark, sf).select("id", dates.is_fabricated_date(d, "2024-10-01").alias("fabricated"), dates.is_suspect_date(d, "2024-10-01", "2024-01-20").alias("suspect"))


@register("news", "SELECT id, date BETWEEN DATE '2023-10-01' AND DATE '2025-03-31' AND date <= DATE '2024-10-01' AS ok FROM news")
def period_gate(spark, sf):
    return news(spark, sf).select("id", dates.period_gate(F.col("date"), F.lit(2024), "2024-10-01").alias("ok"))


@register("news", """, q AS (SELECT *, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'required' ELSE 'or_broker' END AS need, title LIKE '%a%' AS c, title LIKE '%e%' AS b FROM news)
    SELECT id, CASE WHEN need = 'or_broker' AND NOT c AND severity = 'high' THEN 'medium' ELSE severity END AS severity FROM q WHERE need IS NULL OR c OR (need = 'or_broker' AND b)""")
def mention_gate(spark, sf):
    need = F.when(F.col("id") % 3 == 1, "required").when(F.col("id") % 3 == 2, "or_broker")
    return feed.mention_gate(news(spark, sf).withColumn("require_mention", need), F.contains("title", F.lit("a")), F.contains("title", F.lit("e"))).select("id", "severity")


@register("news", "SELECT id, display_priority, date FROM news ORDER BY display_priority DESC NULLS LAST, date DESC, id DESC LIMIT 100")
def feed_top(spark, sf):
    return feed.feed_top(news(spark, sf)).select("id", "display_priority", "date")


@register("news", "SELECT id, date FROM news WHERE coalesce(show_pin, false) OR chart_marked ORDER BY date, display_priority DESC NULLS LAST, id LIMIT 20000")
def pin_timeline(spark, sf):
    return feed.pin_timeline(news(spark, sf), 20_000).select("id", "date")


@register("news", "SELECT id, title FROM news WHERE date = DATE '2024-05-05' AND NOT hidden ORDER BY display_priority DESC NULLS LAST, id DESC LIMIT 500")
def day_rows(spark, sf):
    return feed.day_rows(news(spark, sf), "2024-05-05").select("id", "title")


@register("news", "SELECT id FROM (SELECT id, impact AS status, CASE WHEN id % 4 <> 0 THEN fetched_at END AS c FROM news WHERE NOT hidden) ORDER BY status NULLS FIRST, c NULLS FIRST, id LIMIT 200")
def recheck_queue(spark, sf):
    n = news(spark, sf).withColumns({"status": F.col("impact"), "checked_at": F.when(F.col("id") % 4 != 0, F.col("fetched_at"))})
    return feed.recheck_queue(n, 200).select("id")


@register("news", "SELECT panel, arg_max(id, fetched_at) AS id FROM news WHERE show_pin IS NOT NULL GROUP BY panel")
def latest_brief(spark, sf):
    return feed.latest_brief(news(spark, sf), value="show_pin").select("panel", "id")


@register("bars runs", "SELECT ticker, count(*) AS n, min(date) AS first_date, max(date) AS last_date, (SELECT max(id) FROM runs) AS last_run, CASE WHEN (SELECT arg_max(ok, id) FROM runs) THEN 'ok' ELSE 'degraded' END AS status FROM bars GROUP BY ticker")
def table_metadata(spark, sf):
    return feed.table_metadata(bars(spark, sf), runs(spark, sf))


@register("news", "SELECT panel, count(*) AS total, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (display_priority >= 75) AS urgent, count(*) FILTER (CAST(fetched_at + INTERVAL 7 HOUR AS DATE) = DATE '2025-01-03') AS fetched_today FROM news GROUP BY panel")
def feed_counters(spark, sf):
    return feed.feed_counters(news(spark, sf), "2025-01-03")


@register("runs", "SELECT s.source, r.id, r.started_at, r.ok, r.rows_added FROM (SELECT unnest(['s0', 's1', 's2', 'never']) AS source) s LEFT JOIN (SELECT source, max(id) AS id, arg_max(started_at, id) AS started_at, arg_max(ok, id) AS ok, arg_max(rows_added, id) AS rows_added FROM runs GROUP BY source) r USING (source)")
def last_runs(spark, sf):
    return feed.last_runs(runs(spark, sf), ["s0", "s1", "s2", "never"])


_LINK = "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'https://vertexaisearch.x/' || id WHEN 2 THEN 'https://a.co/x ' || id WHEN 3 THEN 'https://a.co/' ELSE 'https://a.co/news/' || id END"


def _linked(spark, sf):
    i = F.col("id").cast("string")
    k = F.col("id") % 5
    url = F.when(k == 1, F.concat(F.lit("https://vertexaisearch.x/"), i)).when(k == 2, F.concat(F.lit("https://a.co/x "), i)).when(k == 3, F.lit("https://a.co/")).when(k == 4, F.concat(F.lit("https://a.co/news/"), i))
    return news(spark, sf).withColumn("source_url", url)


@register("news", f""", n AS (SELECT *, {_LINK} AS u FROM news WHERE NOT hidden) SELECT count(*) AS total, count(*) FILTER (u IS NULL OR u = '') AS no_link, count(*) FILTER (u LIKE '%vertexaisearch%') AS redirect_links,
    count(*) FILTER (regexp_matches(u, '\\s') OR regexp_matches(u, '[,;]\\s*https?://')) AS malformed_links,
    count(*) FILTER (regexp_matches(title, '(SUMMARY|IMPACT_LEVEL|SOURCE|URL|CATEGORY|EVENT_DATE|PUBLISH_DATE|CONFIDENCE)\\s*:')) AS blob_titles,
    count(*) FILTER ({_PLACEHOLDER} OR (month(date) = 6 AND day(date) = 1) OR date > DATE '2024-10-01') AS fabricated_dates, count(*) FILTER (date > DATE '2024-10-01') AS future_dates,
    count(*) FILTER (severity = 'high' AND NOT coalesce(show_pin, false)) AS unpinned_high FROM n""")
def quality_report(spark, sf):
    return feed.quality_report(_linked(spark, sf), "2024-10-01")


@register("news", f""", n AS (SELECT date, {_LINK} AS u FROM news) SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n, count(*) FILTER (u LIKE 'https://a.co/%' AND u <> 'https://a.co/') AS linked FROM n GROUP BY ALL""")
def yearly_linked(spark, sf):
    return feed.yearly_linked(_linked(spark, sf))


@register("news", "SELECT panel, category, count(*) AS n FROM news GROUP BY ALL")
def category_counts(spark, sf):
    return feed.category_counts(news(spark, sf))


@register("news", "SELECT category, count(*) FILTER (impact = 'positive') AS positive, count(*) FILTER (impact = 'negative') AS negative, count(*) FILTER (impact = 'neutral') AS neutral FROM news GROUP BY category")
def category_impact(spark, sf):
    return feed.category_impact(news(spark, sf))


@register("news", "SELECT count(*) FILTER (title IS NULL) AS title, count(*) FILTER (display_priority IS NULL) AS display_priority, count(*) FILTER (show_pin IS NULL) AS show_pin FROM news")
def null_counts(spark, sf):
    return feed.null_counts(news(spark, sf), ["title", "display_priority", "show_pin"])


@register("news", "SELECT CAST(year(date) AS INTEGER) AS year, count(DISTINCT date) FILTER (coalesce(show_pin, false)) AS days_before, count(DISTINCT date) FILTER (coalesce(show_pin, false) OR (severity = 'high' AND show_pin = false)) AS days_after FROM news GROUP BY ALL")
def pinned_days(spark, sf):
    return feed.pinned_days(news(spark, sf))


@register("news", f"SELECT panel, {_HASH} AS title_hash, count(*) AS n, min(id) AS first_id FROM news GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return feed.duplicate_groups(news(spark, sf), text.title_hash(F.col("title"), F.col("source_label")))


@register("news", """, b AS (SELECT impact AS status, count(*) AS n FROM news WHERE id % 2 = 0 AND impact <> 'neutral' GROUP BY 1), a AS (SELECT impact AS status, count(*) AS n FROM news WHERE id % 2 = 1 AND impact <> 'negative' GROUP BY 1)
    SELECT coalesce(a.status, b.status) AS status, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS change FROM b FULL JOIN a ON a.status = b.status""")
def status_diff(spark, sf):
    n = news(spark, sf).withColumnRenamed("impact", "status")
    return feed.status_diff(n.where("id % 2 = 0 and status <> 'neutral'"), n.where("id % 2 = 1 and status <> 'negative'"))


@register("news", f", h AS (SELECT *, {_HASH} AS title_hash FROM news) SELECT title_hash, min(id) AS id, arg_min(title, id) AS title, array_to_string(list_sort(list_distinct(list(panel))), ',') AS tags FROM h GROUP BY title_hash")
def collapse_tags(spark, sf):
    n = news(spark, sf).select("id", "title", "panel", text.title_hash(F.col("title"), F.col("source_label")).alias("title_hash"))
    return feed.collapse_tags(n).withColumn("tags", F.array_join("tags", ","))


@register("news", "SELECT 'category' AS kind, category AS value, count(*) AS n FROM news GROUP BY ALL UNION ALL SELECT 'impact', impact, count(*) FROM news GROUP BY ALL")
def insert_summary(spark, sf):
    return feed.insert_summary(news(spark, sf))


@register("news", """, r AS (SELECT *, row_number() OVER (PARTITION BY panel, date, category ORDER BY display_priority DESC NULLS LAST, id DESC) AS rn, count(*) OVER (PARTITION BY panel, date, category) AS n FROM news WHERE NOT hidden)
    SELECT panel, date, category, string_agg('- ' || title, chr(10) ORDER BY rn) AS lines, max(n) AS n FROM r WHERE rn <= 6 GROUP BY ALL""")
def digest_blocks(spark, sf):
    return feed.digest_blocks(news(spark, sf))


@register("news", "SELECT panel, coalesce(max(date) FILTER (date = DATE '2024-02-29'), max(date)) AS date FROM news WHERE NOT hidden GROUP BY panel")
def digest_date(spark, sf):
    return feed.digest_date(news(spark, sf), "2024-02-29")


@register("news", """, p AS (SELECT id, severity, show_pin, unnest(CASE WHEN id % 2 = 0 THEN ['ASW', 'TITLE'] ELSE ['ASW'] END) AS panel FROM news)
    SELECT id, panel, CASE WHEN panel = 'TITLE' AND severity = 'high' THEN 'medium' ELSE severity END AS severity, CASE WHEN panel = 'TITLE' THEN false ELSE show_pin END AS show_pin FROM p""")
def expand_by_panel(spark, sf):
    both = F.when(F.col("id") % 2 == 0, F.array(F.lit("ASW"), F.lit("TITLE"))).otherwise(F.array(F.lit("ASW")))
    return feed.expand_by_panel(news(spark, sf).select("id", "severity", "show_pin", both.alias("panels")), capped="TITLE")


@register("news", "SELECT id, CASE WHEN (panel = 'en' AND category IN ('COMPANY', 'FX')) OR (panel = 'de' AND category = 'OIL') THEN category ELSE 'MACRO' END AS category FROM news")
def coerce_category(spark, sf):
    panels = spark.createDataFrame([("en", ["COMPANY", "FX"]), ("de", ["OIL"])], "panel string, categories array<string>")
    return feed.coerce_category(news(spark, sf), panels).select("id", "category")


@register("news", f", h AS (SELECT *, {_HASH} AS title_hash FROM news) SELECT id, panel, title_hash, row_number() OVER (PARTITION BY panel, title_hash ORDER BY display_priority DESC NULLS LAST, id) = 1 AS survives FROM h")
def rehash_survivors(spark, sf):
    return feed.rehash_survivors(news(spark, sf))


@register("news", "SELECT panel, date, arg_min(title, id) AS remark, arg_min('[' || category || '] ' || title, id) FILTER (severity = 'high') AS pin FROM news GROUP BY ALL")
def batch_pins(spark, sf):
    return feed.batch_pins(news(spark, sf))


@register("news", "SELECT id, impact AS status FROM news WHERE impact = 'negative'")
def actionable(spark, sf):
    return feed.actionable(news(spark, sf).withColumnRenamed("impact", "status"), ["negative"]).select("id", "status")


@register("news", "SELECT category AS url, count(DISTINCT title) AS titles, count(*) AS n FROM news GROUP BY category HAVING count(DISTINCT title) > 1")
def shared_urls(spark, sf):
    return feed.shared_urls(news(spark, sf).withColumn("url", F.col("category")))


# --- scalar columns over whole tables --------------------------------------------------------------------------

_DEDUP = r"regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(coalesce(title, ''), '(?i)\b(?:DATE|SOURCE|SUMMARY|CATEGORY|IMPACT_LEVEL|HEADLINE|URL)\s*:\s*', ' ', 'g'), '\s+-\s+[^-\x{0E00}-\x{0E7F}]+$', '')), '[()\[\]{}\"''`.,!?;:*–—\-_/\\|]', ' ', 'g'), '\s+', '', 'g')"
_GRAMS = "CASE WHEN length(norm) >= 3 THEN list_distinct([substr(norm, i, 3) for i in range(1, length(norm) - 1)]) ELSE [] END"
_NUMBERS = r"list_distinct([replace(x, ',', '') for x in regexp_extract_all(coalesce(title, ''), '[0-9][0-9,]*(?:\.[0-9]+)?')])"


@register("news", f", n AS (SELECT id, {_NORM} AS norm, {_HASH} AS title_hash FROM news) SELECT * FROM n")
def headline_hashes(spark, sf):
    return news(spark, sf).select("id", text.normalize_headline(F.col("title")).alias("norm"), text.title_hash(F.col("title"), F.col("source_label")).alias("title_hash"))


@register("news", f", n AS (SELECT id, title, {_DEDUP} AS norm FROM news) SELECT id, norm, array_to_string(list_sort({_GRAMS}), ' ') AS grams, array_to_string(list_sort({_NUMBERS}), ' ') AS numbers FROM n")
def dedup_keys(spark, sf):
    keys = dedup.headline_keys(news(spark, sf))
    return keys.select("id", "norm", F.array_join(F.array_sort("shingles"), " ").alias("grams"), F.array_join(F.array_sort("numbers"), " ").alias("numbers"))


@register("news", """, c AS (SELECT id, title AS t, regexp_extract(substr(title, 1, 41), '^(.*) ', 1, 's') AS head FROM news)
    SELECT id, CASE WHEN length(t) <= 40 THEN t ELSE rtrim(CASE WHEN length(head) >= 20 THEN head ELSE substr(t, 1, 40) END, ' ') || '…' END AS short FROM c""")
def truncated_titles(spark, sf):
    return news(spark, sf).select("id", text.truncate_headline(F.col("title"), 40, 20).alias("short"))


@register("news", f""", n AS (SELECT id, panel, date, {_NORM} AS norm FROM news), p AS (SELECT a.id AS a, b.id AS b, a.norm AS x, b.norm AS y, list_filter(string_split(a.norm, ' '), lambda t: length(t) >= 4) AS t FROM n a JOIN n b ON b.panel = a.panel AND b.date = a.date AND a.id < b.id)
    SELECT a, b, round(CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda w: contains(y, w)))::DOUBLE / len(t) ELSE 0 END, 6) AS overlap FROM p""")
def token_overlaps(spark, sf):
    n = news(spark, sf).select("id", "panel", "date", text.normalize_headline(F.col("title")).alias("norm"))
    return dedup.token_overlap_pairs(n).withColumn("overlap", F.round("overlap", 6))


_STOPS = ", ".join(f"'{w}'" for w in text.STORY_STOP)


@register("news", rf""", n AS (SELECT id, panel, date, list_filter(regexp_split_to_array(regexp_replace(lower(title), '[()\[\]{{}}\"''`.,!?;:]', ' ', 'g'), '\s+'), lambda t: length(t) >= 3 AND t NOT IN ({_STOPS})) AS t FROM news),
    p AS (SELECT a.id AS a, b.id AS b, len(a.t) AS na, len(b.t) AS nb, len(list_filter(a.t, lambda w: list_contains(b.t, w))) AS s FROM n a JOIN n b ON b.panel = a.panel AND b.date = a.date AND a.id < b.id)
    SELECT a, b, na > 0 AND nb > 0 AND s >= 2 AND s::DOUBLE / greatest(least(na, nb), 1) >= 0.6 AS same FROM p""")
def same_stories(spark, sf):
    return dedup.same_story_pairs(news(spark, sf).select("id", "panel", "date", "title"))


@register("news", "SELECT id, CASE severity WHEN 'high' THEN 100 WHEN 'medium' THEN 50 ELSE 25 END + CASE impact WHEN 'positive' THEN 25 WHEN 'negative' THEN 15 ELSE 5 END + CASE WHEN show_pin THEN 10 ELSE 0 END AS points, upper(severity) AS impact_level FROM news")
def item_priorities(spark, sf):
    s = F.col("severity")
    return news(spark, sf).select("id", rules.item_priority(s, F.col("impact"), F.coalesce("show_pin", F.lit(False))).alias("points"), rules.impact_level(s).alias("impact_level"))


@register("news", "SELECT id, CASE WHEN contains(title, 'zz') THEN 0 ELSE 10 + CASE WHEN contains(title, 'the') THEN 40 ELSE 0 END + CASE WHEN contains(title, 'und') THEN 30 ELSE 0 END END AS score FROM news")
def relevance_scores(spark, sf):
    return news(spark, sf).select("id", rules.keyword_score(F.col("title"), [("the", 40), ("und", 30)], F.lit(10), ["zz"]).alias("score"))


@register("news", ", n AS (SELECT id, (year(date) + CASE WHEN id % 2 = 0 THEN 543 ELSE 0 END)::VARCHAR || strftime(date, '-%m-%d') || ' x' AS d, date FROM news) SELECT id, strftime(date, '%Y-%m-%d') || ' x' AS d FROM n")
def era_dates(spark, sf):
    era = F.concat((F.year("date") + F.when(F.col("id") % 2 == 0, 543).otherwise(0)).cast("string"), F.date_format("date", "-MM-dd"), F.lit(" x"))
    return news(spark, sf).select("id", dates.normalize_era(era).alias("d"))


@register("ticks", "SELECT id, CAST(ts + INTERVAL 7 HOUR AS DATE) AS local_date FROM ticks")
def local_dates(spark, sf):
    return ticks(spark, sf).select("id", dates.local_date(F.col("ts")).alias("local_date"))


@register("crawl", r"SELECT id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_matches(url, '^https?://') AND NOT regexp_matches(url, '^https?://[^/]+/?$') AS usable, regexp_matches(url, '\s') AS malformed FROM crawl")
def link_screens(spark, sf):
    u = F.col("url")
    return crawl(spark, sf).select("id", links.host_of(u).alias("host"), links.is_usable_link(u).alias("usable"), links.is_malformed_link(u).alias("malformed"))


@register("crawl", r"SELECT id, url AS clean FROM crawl")
def sanitized_urls(spark, sf):
    k = F.col("id") % 3
    dirty = F.when(k == 0, F.concat("url", F.lit(","))).when(k == 1, F.concat("url", F.lit(") and more"))).otherwise(F.concat(F.lit("  "), F.col("url"), F.lit(" / https://b.co/x")))
    return crawl(spark, sf).select("id", links.sanitize_url(dirty).alias("clean"))


def crawl_links(spark, sf):
    """Pages with a link: their own, or one of their host with a form that screens look for."""
    k, host = F.col("id") % 7, links.host_of(F.col("url"))
    of_host = lambda *parts: F.concat(F.lit("https://"), host, *(p if not isinstance(p, str) else F.lit(p) for p in parts))
    n = F.col("id").cast("string")
    link = (
        F.when(k == 1, F.concat(F.lit("http://10.0."), (F.col("id") % 200).cast("string"), F.lit(".7/news/12345")))
        .when(k == 2, F.concat(F.lit("https://user:pw@"), host, F.lit("/news/12345")))
        .when(k == 3, of_host("/"))
        .when(k == 4, of_host("/category/", n))
        .when(k == 5, of_host("/news/", (F.col("id") + 100000).cast("string"), "?utm_source=a&b=2&a=1"))
        .when(k == 6, of_host("//2024//05/some-long-slug-", n, "/#top"))
        .otherwise(F.col("url"))
    )
    return crawl(spark, sf).withColumn("link", link)


_HOST = rule_sql.host("url")
CRAWL_LINKS = f""", l AS (SELECT *, CASE id % 7 WHEN 1 THEN 'http://10.0.' || (id % 200) || '.7/news/12345' WHEN 2 THEN 'https://user:pw@' || {_HOST} || '/news/12345' WHEN 3 THEN 'https://' || {_HOST} || '/'
    WHEN 4 THEN 'https://' || {_HOST} || '/category/' || id WHEN 5 THEN 'https://' || {_HOST} || '/news/' || (id + 100000) || '?utm_source=a&b=2&a=1' WHEN 6 THEN 'https://' || {_HOST} || '//2024//05/some-long-slug-' || id || '/#top' ELSE url END AS link FROM crawl)"""


@register("crawl", f"{CRAWL_LINKS} SELECT id, {rule_sql.canonical_url('link')} AS canonical FROM l")
def canonical_urls(spark, sf):
    return crawl_links(spark, sf).select("id", links.canonical_url(F.col("link")).alias("canonical"))


@register("crawl", f"{CRAWL_LINKS} SELECT id, {rule_sql.link_shape('link')} AS shape, {rule_sql.link_safety('link')} AS safety FROM l")
def link_shapes(spark, sf):
    u = F.col("link")
    return crawl_links(spark, sf).select("id", links.link_shape(u).alias("shape"), links.link_safety(u).alias("safety"))


#: A policy measure that the reference's event rules know, in front of three titles of four; the others name none.
POLICY = ["รัฐต่ออายุลดค่าโอน", "กนง. คงอัตราดอกเบี้ยนโยบาย", "ครม. เตรียมขยายมาตรการ LTV"]


def _policy_news(spark, sf):
    lead = F.element_at(F.array(*map(F.lit, POLICY)), (F.col("id") % 4).cast("int"))
    n = news(spark, sf)
    titled = F.when(F.col("id") % 4 == 0, F.col("title")).otherwise(F.concat_ws(" ", lead, "title"))
    return n.withColumn("title", titled).withColumn("fingerprint", classify.event_fingerprint(titled))


_LEAD = "CASE WHEN id % 4 = 0 THEN title ELSE list_extract([" + ", ".join(f"'{x}'" for x in POLICY) + "], CAST(id % 4 AS INTEGER)) || ' ' || title END"
_EVENTS = f", t AS (SELECT * REPLACE ({_LEAD} AS title) FROM news), e AS (SELECT *, {rule_sql.fingerprint('title')} AS fingerprint FROM t)"


@register("news", _EVENTS + """, w AS (SELECT panel, fingerprint, id, date, CASE WHEN date - lag(date) OVER (PARTITION BY panel, fingerprint ORDER BY date, id) > 14 THEN 1 ELSE 0 END AS g FROM e WHERE fingerprint IS NOT NULL)
    SELECT id, sum(g) OVER (PARTITION BY panel, fingerprint ORDER BY date, id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM w""")
def event_runs(spark, sf):
    return dedup.event_runs(_policy_news(spark, sf)).select("id", "run")


@register("news", _EVENTS + """, w AS (SELECT panel, fingerprint, id, date, title, CASE WHEN date - lag(date) OVER (PARTITION BY panel, fingerprint ORDER BY date, id) > 2 THEN 1 ELSE 0 END AS g FROM e WHERE fingerprint IS NOT NULL),
    r AS (SELECT *, sum(g) OVER (PARTITION BY panel, fingerprint ORDER BY date, id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM w),
    k AS (SELECT *, first_value(id) OVER (PARTITION BY panel, fingerprint, run ORDER BY date, length(title) DESC, id) AS keep, min(date) OVER (PARTITION BY panel, fingerprint, run) AS first_date, max(date) OVER (PARTITION BY panel, fingerprint, run) AS last_date FROM r)
    SELECT panel, fingerprint, run, keep, id AS duplicate, first_date, last_date FROM k WHERE id <> keep""")
def event_clusters(spark, sf):
    return dedup.event_clusters(_policy_news(spark, sf), 2)


@register("news", _EVENTS + " SELECT id, fingerprint FROM e")
def policy_fingerprints(spark, sf):
    return _policy_news(spark, sf).select("id", "fingerprint")


@register("news30", f""", n AS (SELECT id, panel, date, {_DEDUP} AS norm, {_NUMBERS} AS nums FROM news), g AS (SELECT *, {_GRAMS} AS s FROM n),
    p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) AS na, len(b.s) AS nb, least(length(a.norm), length(b.norm)) AS chars, len(a.nums) AS ka, len(b.nums) AS kb, len(list_intersect(a.nums, b.nums)) AS k
          FROM g a JOIN g b ON a.panel = b.panel AND a.id < b.id AND abs(a.date - b.date) <= 2 WHERE len(a.s) > 0 AND len(b.s) > 0)
    SELECT a, b, round(i::DOUBLE / (na + nb - i), 6) AS jaccard, round(i::DOUBLE / least(na, nb), 6) AS containment FROM p
    WHERE (i::DOUBLE / (na + nb - i) >= 0.5 OR (i::DOUBLE / least(na, nb) >= 0.62 AND chars >= 20)) AND NOT (ka > 0 AND kb > 0 AND k::DOUBLE / greatest(ka + kb - k, 1) < 0.5)""")
def near_dup_pairs(spark, sf):
    return dedup.near_dup_pairs(dedup.headline_keys(dedup.dealt(news(spark, sf, 30)))).select("a", "b", F.round("jaccard", 6).alias("jaccard"), F.round("containment", 6).alias("containment"))


def near_dup_survivors(spark, sf):
    n = news(spark, sf, 30)
    return dedup.drop_near_dups(n.where("id % 3 <> 0"), n.where("id % 3 = 0")).select("id", "panel", "title")


QUERIES["near_dup_survivors"] = near_dup_survivors
