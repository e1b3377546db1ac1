"""Registered queries of levels, remarks, dates, quotes, crawl audits, and of the chart and feed scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyroom.functions import classify, dates, publishers, rules, text
from tallyroom.operators import audits, dedup, feed, linkjobs
from tallyroom.operators.scratch import Kept
from tallyroom.plans import rule_sql
from tallyroom.plans.adapters import bars, crawl, news, ticks
from tallyroom.plans.queries import _NORM as NORM
from tallyroom.plans.queries import _EVENTS as EVENTS
from tallyroom.plans.queries import CRAWL_LINKS, _policy_news, crawl_links, register
from tallyroom.sources import feeds
from tallyroom.streaming import jobs

# --- scans -----------------------------------------------------------------------------------------------------


@register("bars", "SELECT replace(ticker, ' ', '_') AS ticker, date, close, CAST(CASE WHEN volume % 3 = 0 THEN 0 ELSE volume END AS DOUBLE) AS volume FROM bars WHERE volume % 5 <> 0")
def chart_scan(spark, sf):
    """Bars as chart payloads with parallel arrays, one file per ticker: days without a close drop out, missing volumes are 0."""
    kept = Kept(spark, "charts")
    day = F.struct("date", F.unix_timestamp(F.col("date").cast("timestamp")).alias("ts"), F.when(F.col("volume") % 5 != 0, F.col("close")).alias("close"), F.when(F.col("volume") % 3 != 0, F.col("volume").cast("double")).alias("volume"))
    rows = bars(spark, sf).groupBy(F.regexp_replace("ticker", " ", "_").alias("ticker")).agg(F.sort_array(F.collect_list(day)).alias("d"))  # a ticker's days
    quote = F.struct(F.col("d.close").alias("close"), F.col("d.volume").alias("volume"))
    result = F.struct(F.struct(F.col("ticker").alias("symbol")).alias("meta"), F.col("d.ts").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    payload = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"})
    rows.select("ticker", payload.alias("value")).write.partitionBy("ticker").text(f"{kept.base}/in")
    return feeds.read_chart_json(spark, f"{kept.base}/in").select("ticker", "date", "close", "volume")


@register("crawl", f"{CRAWL_LINKS} SELECT 'Title ' || id || ' & <more>' AS title, link, make_timestamp((1754301600 + id * 3600) * 1000000) AS published, CAST(id AS VARCHAR) AS guid, CASE WHEN id % 2 = 0 THEN 'Paper ' || (id % 7) END AS source FROM l")
def feed_scan(spark, sf):
    """Pages' links as items of a feed, written and scanned."""
    kept = Kept(spark, "feeds")
    i = F.col("id")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1754301600) + i * 3600), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    title = F.concat(F.lit("Title "), i.cast("string"), F.lit(" & <more>"))
    items = crawl_links(spark, sf).select(F.replace(F.replace(title, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")).alias("title"), F.concat(F.lit(" "), "link").alias("link"), stamp.alias("pubDate"), i.cast("string").alias("guid"), F.when(i % 2 == 0, F.concat(F.lit("Paper "), (i % 7).cast("string"))).alias("source"))
    items.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(f"{kept.base}/in")
    return feeds.read_feed_xml(spark, f"{kept.base}/in")


# --- levels, remarks, dates ------------------------------------------------------------------------------------


@register("news", """SELECT id, CASE WHEN display_priority > 0 THEN display_priority WHEN id % 2 = 0 THEN least(50 + id % 100, 125)
    ELSE CASE severity WHEN 'high' THEN 100 WHEN 'medium' THEN 50 ELSE 25 END + CASE impact WHEN 'positive' THEN 25 WHEN 'negative' THEN 15 ELSE 5 END + CASE WHEN show_pin THEN 10 ELSE 0 END END AS priority FROM news""")
def display_priorities(spark, sf):
    """Given values, scores on every other row, and points for the rest."""
    score = F.when(F.col("id") % 2 == 0, F.col("id") % 100)
    return news(spark, sf).select("id", rules.display_priority(F.col("display_priority"), score, F.col("severity"), F.col("impact"), F.coalesce("show_pin", F.lit(False))).alias("priority"))


@register("news", """, l AS (SELECT id, CASE WHEN id % 3 > 0 THEN severity END AS s, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'HIGH' WHEN 2 THEN 'Low' ELSE 'x' END AS l FROM news)
    SELECT id, coalesce(s, CASE WHEN lower(l) IN ('high', 'low') THEN lower(l) END, 'medium') AS severity, coalesce(l, upper(coalesce(s, 'medium'))) AS impact_level FROM l""")
def filled_levels(spark, sf):
    k = F.col("id") % 4
    level = F.when(k == 1, "HIGH").when(k == 2, "Low").when(k == 3, "x")
    return news(spark, sf).select("id", rules.filled_levels(F.when(F.col("id") % 3 > 0, F.col("severity")), level).alias("x")).select("id", "x.*")


@register("news", """, r AS (SELECT id, CASE WHEN id % 2 = 0 THEN title ELSE ' ' END AS c, CASE WHEN id % 3 = 0 THEN source_label END AS s, CASE WHEN id % 5 = 0 THEN panel ELSE '' END AS m FROM news)
    SELECT id, coalesce(nullif(trim(c), ''), nullif(trim(s), ''), nullif(trim(m), '')) AS remark, CASE WHEN trim(c) <> '' THEN 'company' WHEN trim(s) <> '' THEN 'sector' WHEN trim(m) <> '' THEN 'macro' END AS category FROM r""")
def collapsed_remarks(spark, sf):
    """Rows' title, source and panel as three legacy columns, blank and missing by id."""
    i = F.col("id")
    columns = F.when(i % 2 == 0, F.col("title")).otherwise(" "), F.when(i % 3 == 0, F.col("source_label")), F.when(i % 5 == 0, F.col("panel")).otherwise("")
    return news(spark, sf).select("id", classify.remarks(*columns).alias("x")).select("id", "x.*")


@register("news", f""", b AS (SELECT id, {rule_sql.first_match('title', rules.REMARK_RULES, 'company')} AS bucket, trim(title) AS t FROM news WHERE trim(coalesce(title, '')) <> '')
    SELECT id, CASE WHEN bucket = 'company' THEN t END AS company, CASE WHEN bucket = 'sector' THEN t END AS sector, CASE WHEN bucket = 'macro' THEN t END AS macro FROM b""")
def remark_columns(spark, sf):
    """All titles: what no rule takes is the company's."""
    return news(spark, sf).where("trim(coalesce(title, '')) <> ''").select("id", rules.remark_columns(F.col("title")).alias("x")).select("id", "x.*")


@register("news", r""", f AS (SELECT id, unnest(regexp_extract_all(title, '(?i)([a-z][a-z0-9]*|[0-9]+(?:[.,][0-9]+)*\s*[%$]?)')) AS w, generate_subscripts(regexp_extract_all(title, '(?i)([a-z][a-z0-9]*|[0-9]+(?:[.,][0-9]+)*\s*[%$]?)'), 1) AS i FROM news WHERE title IS NOT NULL),
    g AS (SELECT id, list(w ORDER BY i) AS k FROM f WHERE length(regexp_replace(w, '[.,%$]', '', 'g')) >= 2 AND lower(regexp_replace(w, '[.,%$]', '', 'g')) NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'from', '2569', '2568', '2567', '69', '68', '67', '66') GROUP BY id)
    SELECT id, array_to_string(k, ' ') AS keywords FROM g""")
def title_keywords(spark, sf):
    """Distinctive keywords of all titles that have any."""
    words = text.distinctive_keywords(F.col("title"))
    return news(spark, sf).select("id", words.alias("k")).where("size(k) > 0").select("id", F.array_join("k", " ").alias("keywords"))


@register("news", f""", b AS (SELECT id, concat_ws(' ', CASE id % 5 WHEN 0 THEN 'กนง. LTV' WHEN 1 THEN 'ASW และ SET' WHEN 2 THEN 'แบงก์ชาติ GDP' WHEN 3 THEN 'ASWx BOI' END, title) AS t FROM news)
    SELECT id, coalesce(array_to_string([{', '.join(f'CASE WHEN {rule_sql.test("t", p)} THEN {i} END' for i, p in enumerate(audits.ENTITIES))}], ','), '') AS entities FROM b""")
def title_entities(spark, sf):
    """Entities of all titles, behind names of some; arrays are joined without their nulls."""
    i = F.col("id") % 5
    names = F.when(i == 0, "กนง. LTV").when(i == 1, "ASW และ SET").when(i == 2, "แบงก์ชาติ GDP").when(i == 3, "ASWx BOI")
    return news(spark, sf).select("id", F.array_join(audits.entities_in(F.concat_ws(" ", names, "title")).cast("array<string>"), ",").alias("entities"))


@register("news", f""", k AS (SELECT id, {NORM} AS key FROM news), r AS (SELECT key, 'https://a.co/' || md5(key) AS url FROM (SELECT key FROM k GROUP BY key HAVING min(id) % 2 = 0)) SELECT id, url AS resolved_url FROM k LEFT JOIN r USING (key)""")
def resolved_groups(spark, sf):
    """One lookup per headline form, for half of the forms, written back to all their rows."""
    form = text.normalize_headline(F.col("title"))
    n = news(spark, sf)
    resolved = n.groupBy(form.alias("key")).agg(F.min("id").alias("first")).where("first % 2 = 0").select("key", F.concat(F.lit("https://a.co/"), F.md5("key")).alias("url"))
    return linkjobs.resolve_by_group(n, resolved, form).select("id", "resolved_url")


@register("news", """, r AS (SELECT id, date, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN date WHEN 2 THEN date + 3 ELSE date - 500 END AS found FROM news)
    SELECT CASE WHEN found IS NULL THEN 'not_found' WHEN found = date THEN 'same' WHEN abs(found - date) > 400 THEN 'too_far' ELSE 'corrected' END AS status, count(*) AS n FROM r GROUP BY 1""")
def redate_counts(spark, sf):
    k = F.col("id") % 4
    found = F.when(k == 1, F.col("date")).when(k == 2, F.date_add("date", 3)).when(k == 3, F.date_sub("date", 500))
    return linkjobs.redate_counts(linkjobs.redate(news(spark, sf).withColumn("found", found)))


@register("news", """, d AS (SELECT id, CASE id % 4 WHEN 0 THEN date WHEN 1 THEN date_trunc('month', date)::DATE + 14 WHEN 2 THEN date END AS d FROM news) SELECT id, d AS date, d >= DATE '2023-10-01' AND d <= DATE '2025-03-31' AND d <= DATE '2024-10-01' AS ok FROM d""")
def item_dates(spark, sf):
    """Whole dates, months, bracketed dates and years alone, then the period gate."""
    k = F.col("id") % 4
    day = F.date_format("date", "yyyy-MM-dd")
    stated = F.when(k == 0, day).when(k == 1, F.date_format("date", "yyyy-MM")).when(k == 2, F.concat(F.lit("["), day, F.lit("]"))).otherwise(F.date_format("date", "yyyy"))
    return news(spark, sf).select("id", dates.item_date(stated).alias("date")).withColumn("ok", dates.period_gate(F.col("date"), F.lit(2024), "2024-10-01"))


@register("news", f""", p AS (SELECT id, title AS t, category, unnest(['TITLE', 'ASW', 'X']) AS panel FROM news WHERE title IS NOT NULL)
    SELECT id, panel, CASE panel WHEN 'TITLE' THEN {rule_sql.category('t', 'TITLE')} WHEN 'ASW' THEN {rule_sql.category('t', 'ASW')} ELSE category END AS category FROM p""")
def panel_categories(spark, sf):
    """Each title on three panels: what it is on two of them, and its own category on the third."""
    rows = news(spark, sf).where("title is not null").withColumn("panels", F.array(F.lit("TITLE"), F.lit("ASW"), F.lit("X")))
    by = lambda panel, name: classify.category(F.col("title"), F.lit(None).cast("string"), F.lit(name))
    return feed.expand_by_panel(rows, capped="TITLE", category=by, named=("TITLE", "ASW")).select("id", "panel", "category")


# --- quotes and crawls -----------------------------------------------------------------------------------------

_NOW = "2024-01-20 05:00:00"


@register("ticks", f""", t AS (SELECT *, id % 50 = 0 AND symbol % 2 = 0 AS candle, CAST(ts + INTERVAL 7 HOUR AS DATE) = CAST(TIMESTAMP '{_NOW}' + INTERVAL 7 HOUR AS DATE) AS today FROM ticks WHERE price IS NOT NULL)
    SELECT symbol, price, ts, CASE WHEN candle THEN 'candle' WHEN today THEN 'meta-fallback' ELSE 'meta-pending' END AS source FROM t WHERE candle OR ts >= TIMESTAMP '{_NOW}' - INTERVAL 24 HOUR QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY candle DESC, ts DESC, id DESC) = 1""")
def latest_quotes(spark, sf):
    """Ticks as meta rows, and some of every other symbol's as candles."""
    kind = F.when((F.col("id") % 50 == 0) & (F.col("symbol") % 2 == 0), "candle").otherwise("meta")
    return jobs.latest_quote(ticks(spark, sf).withColumn("kind", kind), _NOW)


_TITLE = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
_KNOWN = list(publishers.NAMES)


@register("crawl", f""", t AS (SELECT id, trim({_TITLE}, ' ') AS t FROM crawl), c AS (SELECT id, t || ' | Bangkok Post' AS page, regexp_replace(lower(t), '[^a-z0-9\\x{{0E00}}-\\x{{0E7F}}]', '', 'g') AS f FROM t WHERE length(t) > 4)
    SELECT id, CASE WHEN id % 7 = 0 THEN 'dead' WHEN id % 7 = 6 THEN 'timeout' WHEN id % 7 IN (1, 2, 4) AND {rule_sql.not_found('page')} THEN 'soft_404' WHEN id % 7 = 1 THEN 'homepage' WHEN id % 7 = 2 THEN 'mismatch' WHEN id % 7 = 3 THEN 'title_unknown'
        WHEN id % 7 = 5 THEN 'title_mismatch_high' WHEN {rule_sql.generic_title('page', 'bangkokpost')} THEN 'title_unknown' WHEN f = '' THEN 'title_mismatch_high' ELSE 'valid' END AS verdict FROM c""")
def crawl_audits(spark, sf):
    """Pages with their own titles on a known host: gone, a front page, another publisher's label, a bare site name, the headline itself, a foreign one, no answer.
    Titles that tell of a missing page, or name no story, come before these."""
    k = F.col("id") % 7
    rows = crawl(spark, sf).select("id", F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("t")).where("length(t) > 4")
    log = rows.select(
        "id", F.when(k == 0, 404).otherwise(200).alias("status"), F.when(k == 6, "timeout").alias("error"), F.when(k == 1, "https://www.bangkokpost.com/").otherwise("https://www.bangkokpost.com/news/12345").alias("final_url"),
        F.when(k == 3, "Bangkok Post").when(k == 5, "ผลฟุตบอลเมื่อคืน").otherwise(F.concat("t", F.lit(" | Bangkok Post"))).alias("page_title"), F.when(k == 5, "zzqq jjkk").otherwise(F.col("t")).alias("headline"), F.when(k == 2, "สยามรัฐ").otherwise("Bangkok Post").alias("source_label"),
    )
    return linkjobs.crawl_audit(log, publishers.alias_table(spark), publishers.carrier_table(spark))


@register("news", EVENTS + """, g AS (SELECT *, CASE WHEN date - lag(date) OVER w > 2 THEN 1 ELSE 0 END AS gap FROM e WHERE fingerprint IS NOT NULL WINDOW w AS (PARTITION BY panel, fingerprint ORDER BY date, id)),
    r AS (SELECT *, sum(gap) OVER (PARTITION BY panel, fingerprint ORDER BY date, id) AS run FROM g)
    SELECT panel, fingerprint, arg_min(id, (date, -length(coalesce(title, '')), id)) AS keep, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM r GROUP BY panel, fingerprint, run""")
def event_sessions(spark, sf):
    return dedup.event_sessions(_policy_news(spark, sf), 2)
