"""Registered queries that take all rows, and all branches, where an older one takes a part."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyroom.functions import text
from tallyroom.operators import linkjobs, prices
from tallyroom.plans.adapters import bars, index, news, table
from tallyroom.plans.queries import _NORM as NORM
from tallyroom.plans.queries import register
from tallyroom.sources import feeds


@register("bars idx", """, f AS (SELECT ticker, arg_min(i.close / b.close, b.date) AS f FROM bars b JOIN idx i USING (date) GROUP BY ticker)
    SELECT ticker, date, round(close * coalesce(f, 1), 6) AS close FROM bars LEFT JOIN f USING (ticker)""")
def rescaled_tickers(spark, sf):
    return prices.rescale_to_stored(bars(spark, sf), index(spark, sf), "ticker").select("ticker", "date", F.round("close", 6).alias("close"))


@register("news", r""", p AS (SELECT id, regexp_replace('• ' || title || ' • ' || panel, '^\s+|\s+$', '', 'g') AS t FROM news WHERE title IS NOT NULL AND panel IS NOT NULL)
    SELECT id, array_to_string(list_filter(list_transform(string_split(t, '•'), lambda x: regexp_replace(regexp_replace(x, '^[-•\s]+', ''), '\s+$', '')), lambda x: x <> ''), chr(10)) AS points FROM p""")
def brief_points(spark, sf):
    """All titles as points of a brief on one line, those with bullets, dashes and blanks of their own too."""
    brief = F.concat(F.lit("KEY_POINTS: • "), F.col("title"), F.lit(" • "), F.col("panel"), F.lit("\nTONE: HIGH\nEND: x"))
    rows = news(spark, sf).where("title is not null and panel is not null")
    return rows.select("id", feeds.bullets(feeds.section(brief, "KEY_POINTS")).alias("points"))


@register(None, """WITH c AS (SELECT conv_id * 1000 + turn AS id, replace(replace(coalesce(text, ''), '---', '- - -'), ':', ';') AS t FROM conversations)
    SELECT id, nullif(trim(regexp_extract(t, '^[ \\t]*([^\\n]+)', 1)), '') AS summary FROM c""")
def record_summaries(spark, sf):
    """Records whose summary is a conversation's text: the value of a field ends with its line."""
    key = F.col("conv_id") * 1000 + F.col("turn")
    said = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("---"), F.lit("- - -")), F.lit(":"), F.lit(";"))
    record = F.concat(F.lit("CATEGORY: MACRO\nHEADLINE: Head\nSUMMARY: "), said, F.lit("\nSOURCE: Paper"))
    rows = table(spark, sf, "conversations").select(key.alias("id"), record.alias("text"))
    return feeds.load_records(rows, ["MACRO"], "2026-09-01").select("id", "summary")


_SCORE = lambda b: f"(SELECT CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains({b}, x)))::DOUBLE / len(w) ELSE 0 END FROM (SELECT list_filter(string_split(a, ' '), lambda x: length(x) >= 4) AS w))"
_WORDS = lambda t: f"list_distinct(list_transform(list_filter(regexp_extract_all({t}, '(?i)([a-z][a-z0-9]*|[0-9]+(?:[.,][0-9]+)*\\s*[%$]?)'), lambda w: length(regexp_replace(w, '[.,%$]', '', 'g')) >= 2 AND lower(regexp_replace(w, '[.,%$]', '', 'g')) NOT IN ({', '.join(repr(w) for w in text.KEYWORD_STOP)})), lambda w: lower(w)))"
_FOUND = f""", f AS (SELECT id, title, panel, {NORM} AS a, {NORM.replace('coalesce(title', 'coalesce(other')} AS b, other FROM (SELECT id, title, panel, CASE id % 3 WHEN 0 THEN 'other words ' || title WHEN 1 THEN substr(title, 1, length(title) // 2) ELSE panel END AS other FROM news WHERE title IS NOT NULL AND panel IS NOT NULL))"""


def _results(spark, sf):
    """Headlines, and of each what a search might give: all its words and more, the first half of them, or none."""
    n = news(spark, sf).where("title is not null and panel is not null")
    k = F.col("id") % 3
    half = F.substring(F.col("title"), F.lit(1), F.floor(F.length("title") / 2).cast("int"))
    return n, n.select("id", F.when(k == 0, F.concat(F.lit("other words "), "title")).when(k == 1, half).otherwise(F.col("panel")).alias("other"), "title")


@register("news", f"""{_FOUND}, n AS (SELECT *, CASE id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [string_split(title, ' ')[1]] ELSE ['zzz', panel] END AS names FROM f)
    SELECT id, other AS title FROM n WHERE (len(names) = 0 OR len(list_filter(names, lambda x: contains(lower(other), lower(x)))) > 0) AND ({_SCORE('b')} >= 0.6 OR (len(names) > 0 AND len(list_intersect({_WORDS('title')}, {_WORDS('other')})) >= 3))""")
def named_candidates(spark, sf):
    """Headlines without a company, with one that the result may name, and with one that it rarely names."""
    n, found = _results(spark, sf)
    k = F.col("id") % 4
    names = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.element_at(F.split("title", " "), 1))).otherwise(F.array(F.lit("zzz"), "panel"))
    results = found.select("id", F.lit(1).alias("rank"), F.col("other").alias("title"), F.concat(F.lit("https://a.co/news/1000"), F.col("id").cast("string")).alias("url"))
    return linkjobs.best_candidate(n.select("id", "title", names.alias("aliases")), results).select("id", "title")


@register("news", f"""{_FOUND}, s AS (SELECT id, unnest([0, 1]) AS rank, unnest([{_SCORE('b')}, {_SCORE('a')}]) AS score, unnest(['https://a.co/news/1', 'https://m.b.co/news/2']) AS url, unnest([id % 5 IN (1, 2), id % 5 = 0]) AS same FROM f)
    SELECT id, rank, url, round(score, 6) AS score, same FROM s WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY id ORDER BY same DESC, score DESC, rank) = 1""")
def mixed_candidates(spark, sf):
    """Two results per headline, a reworded one and the headline itself; its publisher has the first, the second or none."""
    n, found = _results(spark, sf)
    k = F.col("id") % 5
    host = F.when(k == 0, "b.co").when(k.isin(1, 2), "a.co").otherwise("c.co")
    pairs = F.posexplode(F.array(F.struct(F.col("other").alias("t"), F.lit("https://a.co/news/1").alias("u")), F.struct(F.col("title").alias("t"), F.lit("https://m.b.co/news/2").alias("u")))).alias("rank", "x")
    results = found.select("id", pairs).select("id", "rank", F.col("x.t").alias("title"), F.col("x.u").alias("url"))
    return linkjobs.rank_candidates(n.select("id", "title", host.alias("host")), results).withColumn("score", F.round("score", 6))
