"""Registered queries of the classification, record and link jobs: test literals blended into whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import tallyroom.plans.feed_queries  # noqa: F401  registers its own
import tallyroom.plans.story_queries  # noqa: F401
import tallyroom.plans.whole_queries  # noqa: F401
from tallyroom.functions import classify, links, rules, text
from tallyroom.operators import audits, linkjobs, prices, tables
from tallyroom.operators import feed as feed_ops
from tallyroom.plans import rule_sql
from tallyroom.plans.adapters import bars, crawl, index, news, table, with_views
from tallyroom.plans.queries import _NORM as NORM
from tallyroom.plans.queries import CRAWL_LINKS, ORACLE_SQL, QUERIES, crawl_links, register
from tallyroom.sources import feeds

HEADLINES = [
    "ครม. ลดวีซ่าฟรีเหลือ 30 วัน",
    "ราคาน้ำมันดิบ Urals พุ่งแตะ 100 ดอลลาร์",
    "เงินบาทแข็งค่าสุดในรอบปี",
    "กนง. คงอัตราดอกเบี้ยนโยบาย 1.00%",
    "ครม. ขยายลดค่าธรรมเนียมโอนบ้าน",
    "ศุภาลัย เปิดโครงการใหม่",
    "อสังหาฯ กรุงเทพชะลอตัว",
    "รัฐต่ออายุลดค่าโอน-จดจำนอง และผ่อนคลาย LTV ถึงกลางปี 70",
    "หุ้น TITLE เทรด SET วันแรก",
    "PHUKET TITLE DEED PROBE",
    "ASW presale มูลค่า 7 ล้านบาท",
]
RECORD = "CATEGORY: [{}] HEADLINE: {} SUMMARY: short text IMPACT_LEVEL: [HIGH | LOW] SOURCE: Bangkok Post URL: https://a.co/news/{} EVENT_DATE: 2569-08-15 PUBLISH_DATE: 2026-08-17"


def _blended(spark, sf):
    """News rows with a literal in front of the title: row i has literal i mod N."""
    literal = F.element_at(F.array(*map(F.lit, HEADLINES)), (F.col("id") % len(HEADLINES) + 1).cast("int"))
    return news(spark, sf).withColumns({"title": F.concat_ws(" ", literal, "title"), "literal": literal})


#: The same rows in SQL: t is the literal and the row's own title.
_BLEND = ", b AS (SELECT id, list_extract([" + ", ".join(f"'{h}'" for h in HEADLINES) + f"], CAST(id % {len(HEADLINES)} + 1 AS INTEGER)) || ' ' || title AS t FROM news)"


@register("news", f"{_BLEND} SELECT id, {rule_sql.category('t', 'TITLE')} AS on_title, {rule_sql.category('t', 'ASW')} AS on_asw FROM b")
def categories(spark, sf):
    t = F.col("title")
    no_hint = F.lit(None).cast("string")
    return _blended(spark, sf).select("id", classify.category(t, no_hint, F.lit("TITLE")).alias("on_title"), classify.category(t, no_hint, F.lit("ASW")).alias("on_asw"))


@register("news", f"{_BLEND} SELECT id, {rule_sql.remark_bucket('t')} AS bucket, {rule_sql.event_type('t')} AS event FROM b")
def remark_buckets(spark, sf):
    t = F.col("title")
    return _blended(spark, sf).select("id", rules.remark_bucket(t).alias("bucket"), rules.event_type(t).alias("event"))


@register(None, """WITH c AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id FROM conversations)
    SELECT id, 0 AS block_no, CASE WHEN conv_id % 2 = 0 THEN 'COMPANY' ELSE 'MACRO' END AS category, 'Head ' || id AS headline, 'short text' AS summary, 'HIGH' AS impact_level, 'high' AS severity, 'Bangkok Post' AS source,
           'https://a.co/news/' || id AS url, NULL::VARCHAR AS confidence, DATE '2026-08-15' AS date FROM c""")
def record_load(spark, sf):
    """Whole conversations: each text follows its record after a separator line, without a field, and so gives no row."""
    key = F.col("conv_id") * 1000 + F.col("turn")
    record = F.format_string(RECORD.replace("{}", "%s"), F.when(F.col("conv_id") % 2 == 0, "COMPANY").otherwise("TOURISM"), F.concat(F.lit("Head "), key), key.cast("string"))
    rows = table(spark, sf, "conversations").select(key.alias("id"), F.concat(record, F.lit("\n---\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return feeds.load_records(rows, ["COMPANY", "MACRO"], "2026-09-01")


@register("crawl", r"""SELECT id, trim(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title, 'title' AS origin FROM crawl""")
def page_titles(spark, sf):
    t = feeds.page_title(F.col("html"))
    return crawl(spark, sf).select("id", t["title"].alias("title"), t["origin"].alias("origin"))


@register("crawl", r"""SELECT id, CASE id % 3 WHEN 0 THEN DATE '2024-05-01' + CAST(id % 9 AS INTEGER) WHEN 1 THEN try_cast(substr(nullif(regexp_extract(html, '([0-9]{4})', 1), ''), 1, 4) || '-02-03' AS DATE) END AS published FROM (SELECT id, CASE WHEN regexp_matches(html, '"datePublished"|published_time|<time') THEN NULL ELSE '20' || lpad(CAST(id % 90 AS VARCHAR), 2, '0') END AS html FROM crawl)""")
def page_dates(spark, sf):
    """Pages with a time tag, with a dated path of a year by id, or with neither."""
    k = F.col("id") % 3
    year = F.concat(F.lit("20"), F.lpad((F.col("id") % 90).cast("string"), 2, "0"))
    dated = F.when(k == 0, F.concat("html", F.lit('<time datetime="2024-05-0'), (F.col("id") % 9 + 1).cast("string"), F.lit('T00:00">'))).otherwise(F.col("html"))
    url = F.when(k == 1, F.concat(F.lit("https://a.co/"), year, F.lit("/02/03/story"))).otherwise(F.col("url"))
    return crawl(spark, sf).select("id", feeds.published_date(dated, url).alias("published"))


@register("news", """, r AS (SELECT id, date, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN date WHEN 2 THEN date + 3 ELSE date - 500 END AS found FROM news)
    SELECT id, CASE WHEN found IS NULL THEN 'not_found' WHEN found = date THEN 'same' WHEN abs(found - date) > 400 THEN 'too_far' ELSE 'corrected' END AS status, CASE id % 4 WHEN 2 THEN found ELSE date END AS new_date FROM r""")
def redate(spark, sf):
    k = F.col("id") % 4
    found = F.when(k == 1, F.col("date")).when(k == 2, F.date_add("date", 3)).when(k == 3, F.date_sub("date", 500))
    return linkjobs.redate(news(spark, sf).withColumn("found", found)).select("id", "status", "new_date")


_TITLE = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


@register("crawl", f"""{CRAWL_LINKS}, v AS (SELECT id, link, CASE id % 11 WHEN 0 THEN NULL WHEN 1 THEN 404 WHEN 2 THEN 403 WHEN 3 THEN 429 WHEN 4 THEN 500 ELSE 200 END AS s, CASE WHEN id % 11 = 5 THEN 'Page not found - ' ELSE '' END || {_TITLE} AS t FROM l)
    SELECT id, CASE WHEN s IS NULL THEN 'timeout' WHEN {rule_sql.link_safety('link')} = 'unsafe' THEN 'unsafe' WHEN s = 404 THEN 'dead' WHEN s = 403 THEN 'blocked' WHEN s = 429 THEN 'rate_limited' WHEN s = 500 THEN 'unknown'
        WHEN {rule_sql.test('t', linkjobs.NOT_FOUND.replace(chr(92) + 'b404' + chr(92) + 'b', '(?:^|[^A-Za-z0-9_])404(?:$|[^A-Za-z0-9_])'))} THEN 'soft_404' WHEN {rule_sql.link_shape('link')} = 'homepage' THEN 'homepage' ELSE 'valid' END AS verdict FROM v""")
def crawl_verdicts(spark, sf):
    """Pages' own links and titles; codes and errors, which the table lacks, by id."""
    k = F.col("id") % 11
    status = F.when(k == 0, None).when(k == 1, 404).when(k == 2, 403).when(k == 3, 429).when(k == 4, 500).otherwise(200)
    title = F.concat(F.when(k == 5, "Page not found - ").otherwise(""), F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    return crawl_links(spark, sf).select("id", linkjobs.crawl_verdict(status, F.when(k == 0, "timeout"), F.col("link"), title).alias("verdict"))


def _labelled(spark, sf):
    """Links with labels that name their host, its parent's alias, or neither."""
    k = F.col("id") % 3
    first = F.upper(F.element_at(F.split(links.host_of(F.col("url")), r"\."), 1))
    label = F.when(k == 0, F.concat(first, F.lit(" Daily"))).when(k == 1, "The Example Post").otherwise("Some Paper")
    return crawl_links(spark, sf).select("id", F.lit("p").alias("panel"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"), "link", "url", label.alias("source_label"))


_LABELLED = f", h AS (SELECT id, link, {rule_sql.host('url')} AS own, {rule_sql.host('link')} AS host FROM l), lab AS (SELECT *, CASE id % 3 WHEN 0 THEN upper(split_part(own, '.', 1)) || ' Daily' WHEN 1 THEN 'The Example Post' ELSE 'Some Paper' END AS label, regexp_matches(host, '(^|\\.)example\\.com$') AS listed FROM h)"
#: A label matches by the first part of its host, or of the listed parent, or by the parent's alias; a listed host with another label is a mismatch.
_VERDICT = "CASE WHEN contains(lower(label), CASE WHEN listed THEN 'example' ELSE split_part(host, '.', 1) END) OR (listed AND contains(lower(label), 'example')) THEN 'match' WHEN listed THEN 'mismatch' ELSE 'unknown' END"


def _publishers(spark):
    return spark.createDataFrame([("example.com", "Example")], "host string, alias string"), spark.createDataFrame([("msn.com",)], "host string")


@register("crawl", f"{CRAWL_LINKS}{_LABELLED} SELECT id, {_VERDICT} AS verdict FROM lab")
def label_host_verdicts(spark, sf):
    return linkjobs.label_host_verdict(_labelled(spark, sf), *_publishers(spark), url="link")


_CLAIMED = "SELECT *, first_value(title) OVER (PARTITION BY panel, url ORDER BY id) AS ft, first_value(id) OVER (PARTITION BY panel, url ORDER BY id) AS fi FROM n"


@register("news", f""", n AS (SELECT id, panel, 'one two three four five six seven eight ' || title AS title, 'https://a.co/news/1234' || (id % 50) AS url FROM news WHERE title IS NOT NULL),
    f AS ({_CLAIMED}) SELECT id, CASE WHEN id = fi OR {rule_sql.same_story('title', 'ft', text.STORY_STOP)} THEN url END AS url_kept FROM f""")
def url_collisions_same_story(spark, sf):
    rows = news(spark, sf).where("title is not null").select("id", "panel", F.concat(F.lit("one two three four five six seven eight "), F.col("title")).alias("title"), F.concat(F.lit("https://a.co/news/1234"), F.col("id") % 50).alias("url"))
    return linkjobs.clear_collisions(rows).select("id", "url_kept")


@register("news", f""", n AS (SELECT id, panel, title, CASE WHEN id % 4 > 0 THEN 'https://a.co/news/1234' || (id % 50) END AS url FROM news WHERE title IS NOT NULL),
    f AS ({_CLAIMED}) SELECT id, CASE WHEN id = fi OR {rule_sql.same_story('title', 'ft', text.STORY_STOP)} THEN url END AS url_kept FROM f""")
def url_collisions(spark, sf):
    """Rows' own titles; a quarter of the rows has no link."""
    url = F.when(F.col("id") % 4 > 0, F.concat(F.lit("https://a.co/news/1234"), F.col("id") % 50))
    rows = news(spark, sf).where("title is not null").select("id", "panel", "title", url.alias("url"))
    return linkjobs.clear_collisions(rows).select("id", "url_kept")


@register("crawl", "SELECT id, CASE WHEN id % 4 = 0 THEN 'dead' ELSE 'valid' END AS status, CASE WHEN id % 4 <> 0 THEN url END AS url, 3 AS attempts, id % 4 <> 0 AS verified FROM crawl WHERE id % 5 <> 0")
def verdict_write_back(spark, sf):
    rows = crawl(spark, sf).select("id", "url", F.lit(2).alias("attempts"))
    audit = rows.select("id", F.when(F.col("id") % 5 == 0, "https://other.co/x").otherwise(F.col("url")).alias("url"), F.when(F.col("id") % 4 == 0, "dead").otherwise("valid").alias("status"))
    return linkjobs.write_back(linkjobs.apply_verdicts(rows, audit)).select("id", "status", "url", "attempts", "verified")


_SHARED = "(SELECT CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(b, x)))::DOUBLE / len(w) ELSE 0 END FROM (SELECT list_filter(string_split(a, ' '), lambda x: length(x) >= 4) AS w))"
_FORMS = f", f AS (SELECT id, title, {NORM} AS a, {NORM.replace('coalesce(title', 'coalesce(other')} AS b, other FROM (SELECT id, title, CASE id % 3 WHEN 0 THEN 'other words ' || title WHEN 1 THEN substr(title, 1, length(title) // 2) ELSE panel END AS other FROM news WHERE title IS NOT NULL AND panel IS NOT NULL))"


def _results(spark, sf):
    """Headlines, and of each what a search might give: all its words and more, the first half of them, or none."""
    n = news(spark, sf).where("title is not null and panel is not null")
    k = F.col("id") % 3
    half = F.substring(F.col("title"), F.lit(1), F.floor(F.length("title") / 2).cast("int"))
    return n, n.select("id", F.when(k == 0, F.concat(F.lit("other words "), "title")).when(k == 1, half).otherwise(F.col("panel")).alias("title"))


@register("news", f"{_FORMS} SELECT id, 1 AS rank, other AS title, 'https://a.co/news/1000' || id AS url FROM f WHERE {_SHARED} >= 0.6")
def candidates(spark, sf):
    n, found = _results(spark, sf)
    results = found.select("id", F.lit(1).alias("rank"), "title", F.concat(F.lit("https://a.co/news/1000"), F.col("id").cast("string")).alias("url"))
    return linkjobs.best_candidate(n.select("id", "title", F.array().cast("array<string>").alias("aliases")), results)


@register("news", f"{_FORMS}, s AS (SELECT id, {_SHARED} AS score FROM f) SELECT id, 1 AS rank, 'https://m.b.co/news/2' AS url, score, true AS same FROM s WHERE score >= 0.6")
def ranked_candidates(spark, sf):
    """Two links per result: the second is of the headline's publisher and wins."""
    n, found = _results(spark, sf)
    hosts = F.array(F.lit("https://a.co/news/1"), F.lit("https://m.b.co/news/2"))
    return linkjobs.rank_candidates(n.select("id", "title", F.lit("b.co").alias("host")), found.select("id", "title", F.posexplode(hosts).alias("rank", "url")))


@register("news", r""", n AS (SELECT id, regexp_replace(lower(title), '[^a-z0-9\x{0E00}-\x{0E7F}]', '', 'g') AS a, regexp_replace(lower(title || ' more text'), '[^a-z0-9\x{0E00}-\x{0E7F}]', '', 'g') AS b FROM news),
    x AS (SELECT id, a, b, unnest(CASE WHEN length(a) >= 2 THEN [substr(a, i, 2) for i in range(1, length(a))] ELSE []::VARCHAR[] END) AS g FROM n), y AS (SELECT id, unnest([substr(b, i, 2) for i in range(1, length(b))]) AS g FROM n),
    cx AS (SELECT id, g, count(*) AS c FROM x GROUP BY ALL), cy AS (SELECT id, g, count(*) AS c FROM y GROUP BY ALL), s AS (SELECT id, sum(least(cx.c, cy.c)) AS k FROM cx JOIN cy USING (id, g) GROUP BY id)
    SELECT n.id, round(CASE WHEN length(a) < 2 THEN 0 ELSE 2.0 * coalesce(k, 0) / (length(a) + length(b) - 2) END, 6) AS dice FROM n LEFT JOIN s USING (id)""")
def dice_scores(spark, sf):
    pairs = news(spark, sf).select("id", F.col("title").alias("a"), F.concat("title", F.lit(" more text")).alias("b"))
    return linkjobs.dice_bigram(pairs).select("id", F.round("dice", 6).alias("dice"))


@register("news", r""", x AS (SELECT id, regexp_replace(regexp_replace(trim(title || CASE id % 3 WHEN 0 THEN ' | Bangkok Post' WHEN 1 THEN ' - Site' ELSE ' :' END), '[\s|｜\-–—:]+$', ''), '^[\s|｜\-–—:]+', '') AS t FROM news),
    y AS (SELECT *, trim(regexp_extract(t, '^(.*?)(?:\s+[\-–—]\s+|\s*[|｜]\s*)([^|｜]{2,40})$', 1)) AS head FROM x) SELECT id, CASE WHEN length(head) >= 8 THEN head ELSE t END AS title FROM y""")
def stripped_titles(spark, sf):
    """All titles, with a site's name behind a bar or a dash, or none."""
    k = F.col("id") % 3
    site = F.when(k == 0, " | Bangkok Post").when(k == 1, " - Site").otherwise(" :")
    return news(spark, sf).select("id", F.when(F.col("title").isNotNull(), classify.strip_site_suffix(F.concat("title", site))).alias("title"))


@register("news", "SELECT id, title FROM news")
def markup_free_titles(spark, sf):
    return news(spark, sf).select("id", F.concat(F.lit("<![CDATA[<b>"), F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("</b>]]>")).alias("t"), "title").select("id", F.when(F.trim("title") == text.clean_markup(F.col("t")), F.col("title")).alias("title"))


_EVENT_LITERAL = "list_extract([" + ", ".join(f"'{h}'" for h in HEADLINES) + f"], CAST(volume % {len(HEADLINES)} + 1 AS INTEGER))"


@register("bars", f""", e AS (SELECT ticker, date, {rule_sql.event_type(_EVENT_LITERAL)} AS event FROM bars), c AS (SELECT ticker, event, count(*) AS n, min(date) AS first_seen FROM e WHERE event IS NOT NULL GROUP BY ALL)
    SELECT ticker, event, n FROM c QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY n DESC, first_seen, event) = 1""")
def rule_events(spark, sf):
    """Event class that wins per ticker, over remarks of all bars."""
    literal = F.element_at(F.array(*map(F.lit, HEADLINES)), (F.col("volume") % len(HEADLINES) + 1).cast("int"))
    return feed_ops.top_event_type(bars(spark, sf).withColumn("remark", literal))


def rule_summary(spark, sf):
    rows = prices.attach_index(prices.pct_change(bars(spark, sf)), index(spark, sf))
    literal = F.element_at(F.array(*map(F.lit, HEADLINES)), (F.col("volume") % len(HEADLINES) + 1).cast("int"))
    return prices.rule_summary(rows.withColumn("remark", literal))


def rule_summary_english(spark, sf):
    rows = prices.attach_index(prices.pct_change(bars(spark, sf)), index(spark, sf))
    literal = F.element_at(F.array(*map(F.lit, HEADLINES)), (F.col("volume") % len(HEADLINES) + 1).cast("int"))
    return prices.rule_summary(rows.withColumn("remark", literal), "en")


def _summary_sql(lang: str) -> str:
    """Each rule's line as its own table, joined to the tickers; lists are joined without their nulls."""
    t = prices.SUMMARY[lang]
    label = "CASE event " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t["labels"].items()) + " END"
    return with_views("bars idx", f""", j AS (SELECT b.*, i.close AS idx, {_EVENT_LITERAL} AS remark, round((b.close - lag(b.close) OVER w) / lag(b.close) OVER w * 100, 4) AS change,
            avg(b.volume) OVER (PARTITION BY b.ticker ORDER BY b.date ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS mv, min(b.close) OVER v AS lo, max(b.close) OVER v AS hi, row_number() OVER (PARTITION BY b.ticker ORDER BY b.date DESC) AS rn
            FROM bars b LEFT JOIN idx i USING (date) WINDOW w AS (PARTITION BY b.ticker ORDER BY b.date), v AS (PARTITION BY b.ticker ORDER BY b.date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
        k AS (SELECT *, lag(idx) OVER (PARTITION BY ticker ORDER BY date) AS p FROM j),
        m AS (SELECT ticker, remark, abs(coalesce(change, 0) - coalesce((idx - p) / p * 100, 0)) AS impact, date FROM k WHERE idx IS NOT NULL),
        e AS (SELECT ticker, remark FROM m WHERE impact > 0 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY impact DESC, date) = 1),
        c AS (SELECT ticker, {rule_sql.event_type('remark')} AS event, count(*) AS n, min(date) AS seen FROM j GROUP BY ALL HAVING event IS NOT NULL),
        x AS (SELECT ticker, event, n FROM c QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY n DESC, seen, event) = 1),
        l AS (SELECT ticker, list_filter([
            CASE WHEN abs(change) >= 2 THEN printf(CASE WHEN change > 0 THEN '{t['up']}' ELSE '{t['down']}' END, abs(change)) END,
            CASE WHEN volume > 2 * mv THEN printf('{t['volume']}', volume / round(mv, 6)) END, printf('{t['event']}', e.remark),
            CASE WHEN hi > lo THEN printf('{t['range']}', round((close - lo) / (hi - lo) * 100, 6)) END, CASE WHEN event IS NOT NULL THEN printf('{t['wins']}', {label}, n) END], lambda x: x IS NOT NULL) AS b
            FROM j LEFT JOIN e USING (ticker) LEFT JOIN x USING (ticker) WHERE rn = 1)
        SELECT ticker, CASE WHEN len(b) > 0 THEN b ELSE ['{t['none']}'] END AS bullets FROM l""")


QUERIES |= {f.__name__: f for f in (rule_summary, rule_summary_english)}
ORACLE_SQL |= {"rule_summary": _summary_sql("th"), "rule_summary_english": _summary_sql("en")}


@register("news", rf""", p AS (SELECT id, title, title || ' | Bangkok Post' AS page FROM news WHERE title IS NOT NULL)
    SELECT id, CASE WHEN trim(title, ' ') = '' OR {rule_sql.generic_title('page', 'bangkokpost')} THEN 'title_unknown' WHEN regexp_replace(lower(title), '[^a-z0-9\x{{0E00}}-\x{{0E7F}}]', '', 'g') = '' THEN 'title_mismatch_high' ELSE 'match' END AS verdict FROM p""")
def title_verdicts(spark, sf):
    """All headlines against pages with the same title and a site's name after it: one form holds the other, unless the page's title names no story."""
    rows = news(spark, sf).where("title is not null").select("id", F.col("title").alias("headline"), F.concat("title", F.lit(" | Bangkok Post")).alias("page_title"), F.lit("bangkokpost.com").alias("host"))
    return audits.title_verdicts(rows).select("id", "verdict")


def title_mismatches(spark, sf):
    n = news(spark, sf)
    other = n.select((F.col("id") + 1).alias("id"), F.col("title").alias("page_title"))
    return audits.title_verdicts(n.join(other, "id").select("id", F.col("title").alias("headline"), "page_title", F.lit("a.co").alias("host")))


@register("crawl", f"""{CRAWL_LINKS}{_LABELLED}, r AS (SELECT CASE WHEN {rule_sql.link_safety('link')} = 'unsafe' THEN 'unsafe' WHEN {rule_sql.link_shape('link')} = 'homepage' THEN 'homepage' WHEN {_VERDICT} = 'mismatch' THEN 'mismatch'
    WHEN first_value(id) OVER (PARTITION BY link ORDER BY id) <> id THEN 'collision' ELSE 'ok' END AS reason FROM lab) SELECT reason, count(*) AS n, count(*) FILTER (reason = 'ok') AS kept FROM r GROUP BY ALL""")
def link_vet_report(spark, sf):
    rows = _labelled(spark, sf).drop("url").withColumnRenamed("link", "url")
    return audits.vet_report(audits.link_vet(rows, *_publishers(spark)))


@register("crawl", f"""{CRAWL_LINKS}, g AS (SELECT id, link, {rule_sql.host('link')} AS host, CASE WHEN id % 2 = 0 THEN regexp_replace({rule_sql.host('url')}, '^[^.]+[.]', '') ELSE 'other.org' END AS cited FROM l)
    SELECT id, CASE WHEN {rule_sql.link_safety('link')} = 'ok' AND {rule_sql.link_shape('link')} = 'article' AND (host = cited OR ends_with(host, '.' || cited) OR ends_with(cited, '.' || host)) THEN link END AS url_kept FROM g""")
def grounded_links(spark, sf):
    """Pages' links against the parent of their own host, or another one."""
    cited = F.when(F.col("id") % 2 == 0, F.regexp_replace(links.host_of(F.col("url")), "^[^.]+[.]", "")).otherwise("other.org")
    rows = crawl_links(spark, sf).select("id", F.col("link").alias("url"), F.array(cited).alias("cited_hosts"))
    return audits.grounded_links(rows).select("id", "url_kept")


@register("news", """, n AS (SELECT id, coalesce(lower(source_label), '') AS s, lower('src' || (id % 3)) AS a, lower('src' || (id % 19) || ' online') AS b FROM news)
    SELECT id, CASE WHEN s <> '' AND (contains(s, a) OR contains(a, s)) THEN 0 WHEN s <> '' AND (contains(s, b) OR contains(b, s)) THEN 1 ELSE 0 END AS position FROM n""")
def best_chunks(spark, sf):
    """Rows' own source labels against two grounding chunks."""
    number = lambda m: F.concat(F.lit("src"), (F.col("id") % m).cast("string"))
    items = news(spark, sf).select("id", F.col("source_label").alias("source"))
    chunks = items.select("id", F.posexplode(F.array(number(3), F.concat(number(19), F.lit(" online")))).alias("position", "title")).withColumn("uri", F.lit("u"))
    return audits.best_chunk(items, chunks).select("id", "position")


QUERIES["title_mismatches"] = title_mismatches


def _digests(spark, sf):
    """A digest per panel and date: the titles' number and first title of the day."""
    return news(spark, sf).groupBy("panel", "date").agg(F.min_by("title", "id").alias("headline"), F.count(F.lit(1)).cast("int").alias("source_count"), F.max("fetched_at").alias("generated_at"))


_DIGESTS = ", d AS (SELECT panel, date, arg_min(title, id) AS headline, count(*)::INTEGER AS source_count, max(fetched_at) AS generated_at FROM news GROUP BY panel, date)"


@register("news", f"{_DIGESTS} SELECT * FROM d WHERE (panel, date) IN (SELECT (panel, max(date)) FROM d GROUP BY panel)")
def latest_digests(spark, sf):
    return feed_ops.read_digest(_digests(spark, sf))


@register("news", f"{_DIGESTS} SELECT * FROM d WHERE date = DATE '2024-03-01'")
def digests_of_a_day(spark, sf):
    return feed_ops.read_digest(_digests(spark, sf), "2024-03-01")


@register("news", f"{_DIGESTS} SELECT * FROM d")
def all_digests(spark, sf):
    return feed_ops.read_digests(_digests(spark, sf))


@register("news", """, t AS (SELECT panel, date, arg_min(title, id) AS headline, count(*)::INTEGER AS source_count, max(fetched_at) AS generated_at FROM news WHERE date < DATE '2024-09-01' GROUP BY panel, date),
    u AS (SELECT panel, date, CASE WHEN id % 2 = 0 THEN title END AS headline, 1 AS source_count, fetched_at AS generated_at, row_number() OVER (PARTITION BY panel, date ORDER BY fetched_at DESC) AS rn FROM news WHERE date >= DATE '2024-06-01')
    SELECT panel, date, headline, source_count, generated_at FROM u WHERE rn = 1 UNION ALL SELECT * FROM t WHERE date < DATE '2024-06-01' OR NOT EXISTS (SELECT 1 FROM u WHERE u.panel IS NOT DISTINCT FROM t.panel AND u.date = t.date)""")
def upsert_digests(spark, sf):
    """Digests of the first months, and updates from June on of which a key's last one wins, without a headline too."""
    n = news(spark, sf)
    stored = n.where("date < DATE '2024-09-01'").groupBy("panel", "date").agg(F.min_by("title", "id").alias("headline"), F.count(F.lit(1)).cast("int").alias("source_count"), F.max("fetched_at").alias("generated_at"))
    updates = n.where("date >= DATE '2024-06-01'").select("panel", "date", F.when(F.col("id") % 2 == 0, F.col("title")).alias("headline"), F.lit(1).alias("source_count"), F.col("fetched_at").alias("generated_at"))
    return tables.upsert_digest(stored, updates)


@register("news", """SELECT id, CASE WHEN id % 3 > 0 THEN hidden ELSE id % 5 = 1 END AS url_verified, CASE WHEN id % 5 = 1 THEN 'valid' WHEN id % 5 = 2 THEN 'dead' ELSE 'unchecked' END AS source_url_status,
    CASE WHEN id % 2 = 0 THEN 3 ELSE 0 END AS source_url_check_attempts FROM news""")
def insert_defaults(spark, sf):
    """Given values stay: the row's hidden mark serves as a caller's own verified mark on two rows of three."""
    k = F.col("id") % 5
    rows = news(spark, sf).select("id", F.when(F.col("id") % 3 > 0, F.col("hidden")).alias("url_verified"), F.when(k == 1, "valid").when(k == 2, "dead").alias("source_url_status"), F.when(F.col("id") % 2 == 0, 3).alias("source_url_check_attempts"))
    return tables.link_defaults(rows)


_ALIASES = "CASE " + " ".join(f"WHEN {rule_sql.test('t', p)} THEN '{','.join(names)}'" for p, names in classify.ALIAS_RULES) + " ELSE '' END"


@register("news", f"{_BLEND} SELECT id, {_ALIASES} AS aliases FROM b")
def required_aliases(spark, sf):
    return _blended(spark, sf).select("id", F.array_join(classify.required_aliases(F.col("title")), ",").alias("aliases"))


@register("crawl", f"""{CRAWL_LINKS}, c AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'http://www.b.co/apiclick.aspx?ref=x&amp;url=' || replace(replace(link, ':', '%3a'), '/', '%2f') || '&amp;c=1' WHEN id % 3 = 1 THEN link ELSE 'http://b.co/?url=none' END AS c, link FROM l)
    SELECT id, CASE WHEN id % 3 = 2 THEN c WHEN regexp_matches(CASE WHEN id % 3 = 0 THEN split_part(link, '&', 1) ELSE link END, '^https?://[^/]+/?$') THEN CASE WHEN id % 3 = 0 THEN replace(c, '&amp;', '&') ELSE '' END ELSE CASE WHEN id % 3 = 0 THEN split_part(link, '&', 1) ELSE link END END AS publisher FROM c""")
def publisher_urls(spark, sf):
    """Links behind a click tracker, bare ones, and a tracker without a link."""
    k = F.col("id") % 3
    tracked = F.concat(F.lit("http://www.b.co/apiclick.aspx?ref=x&amp;url="), F.replace(F.replace("link", F.lit(":"), F.lit("%3a")), F.lit("/"), F.lit("%2f")), F.lit("&amp;c=1"))
    c = F.when(k == 0, tracked).when(k == 1, F.col("link")).otherwise("http://b.co/?url=none")
    return crawl_links(spark, sf).select("id", links.publisher_url(c).alias("publisher"))


def _retitled(t, company):
    gov = ["(?i)LTV|ค่าโอน|ค่าจดจำนอง|สมาคมบ้านจัดสรร|มาตรการอสังหาฯ", "ลดค่าธรรมเนียม.*(โอน|จดจำนอง|จดทะเบียน|อสังหาฯ|ที่อยู่อาศัย)"]
    return [(company, "COMPANY"), (t.rlike(classify.RATES), "RATES"), (t.rlike(gov[0]) | t.rlike(gov[1]), "GOV_POLICY"), (F.col("category") == "OIL", "ENERGY"), (t.rlike(classify.ASW_INDUSTRY), "INDUSTRY")]


_COMPANY = "(?i)ASW|Assetwise|แอสเซทไวส์|แอสเสทไวส์"


@register("news", f"""{_BLEND}, x AS (SELECT n.id, n.category AS old, b.t FROM news n JOIN b USING (id)), y AS (SELECT old, CASE WHEN {rule_sql.test('t', _COMPANY)} THEN 'COMPANY' WHEN {rule_sql.test('t', classify.RATES)} THEN 'RATES'
    WHEN {rule_sql.test('t', '(?i)LTV|ค่าโอน|ค่าจดจำนอง|สมาคมบ้านจัดสรร|มาตรการอสังหาฯ')} OR {rule_sql.test('t', 'ลดค่าธรรมเนียม.*(โอน|จดจำนอง|จดทะเบียน|อสังหาฯ|ที่อยู่อาศัย)')} THEN 'GOV_POLICY' WHEN old = 'OIL' THEN 'ENERGY' WHEN {rule_sql.test('t', classify.ASW_INDUSTRY)} THEN 'INDUSTRY'
    ELSE CASE WHEN {rule_sql.test('t', 'ภูเก็ต|(?i)phuket')} THEN 'TOURISM' ELSE 'MACRO' END END AS new FROM x) SELECT old AS category_before, new AS category, count(*) AS n FROM y GROUP BY ALL""")
def reclassify_feed(spark, sf):
    """All stored rows by title and stored category, then a promotion out of the rest; rows per move."""
    t = F.col("title")
    moved = feed_ops.reclassify(_blended(spark, sf), _retitled(t, t.rlike(_COMPANY)), "MACRO", [("MACRO", t.rlike("(?i)ภูเก็ต|phuket"), "TOURISM")])
    return feed_ops.category_moves(moved)


@register("news", """, r AS (SELECT id, CASE id % 3 WHEN 0 THEN 'bullish (x)' WHEN 1 THEN 'Bearish' ELSE 'HIGH' END AS tone, title AS a, panel AS b FROM news WHERE title IS NOT NULL AND panel IS NOT NULL AND NOT contains(title, '•') AND trim(title) = title AND NOT regexp_matches(title, '^[-\\s]') AND title <> '')
    SELECT id, a || chr(10) || b AS points, CASE id % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'neutral' END AS tone FROM r""")
def brief_sections(spark, sf):
    """Briefs whose points stand on one line behind bullet signs, the row's own title among them."""
    n = news(spark, sf).where(~F.contains("title", F.lit("•")) & (F.trim("title") == F.col("title")) & ~F.col("title").rlike(r"^[-\s]") & (F.col("title") != "") & F.col("panel").isNotNull())
    k = F.col("id") % 3
    brief = F.concat(F.lit("KEY_POINTS: • "), F.col("title"), F.lit(" • "), F.col("panel"), F.lit("\nTONE: "), F.when(k == 0, "bullish (x)").when(k == 1, "Bearish").otherwise("HIGH"), F.lit("\nEND: x"))
    return n.select("id", feeds.bullets(feeds.section(brief, "KEY_POINTS")).alias("points"), feeds.tone(feeds.section(brief, "TONE")).alias("tone"))
