"""Registered queries of duplicate stories, link claims, publishers, relevance and page metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyroom.functions import links, publishers, rules, text
from tallyroom.operators import audits, dedup, feed
from tallyroom.operators.scratch import Kept
from tallyroom.plans import rule_sql
from tallyroom.plans.adapters import crawl, news, table, with_views
from tallyroom.plans.queries import _DEDUP as DEDUP
from tallyroom.plans.queries import _GRAMS as GRAMS
from tallyroom.plans.queries import _NUMBERS as NUMBERS
from tallyroom.plans.queries import CRAWL_LINKS, ORACLE_SQL, crawl_links, register
from tallyroom.sources import feeds
from tallyroom.streaming import jobs

# --- duplicate stories -----------------------------------------------------------------------------------------

#: s: shingles, nums: numbers, class: the smallest id with equal panel, date, form and numbers.
_STORIES = f""", n AS (SELECT id, panel, date, {DEDUP} AS norm, list_sort({NUMBERS}) AS nums FROM news WHERE panel IS NOT NULL AND date IS NOT NULL), g AS (SELECT *, {GRAMS} AS s FROM n),
    m AS (SELECT *, min(id) OVER (PARTITION BY panel, date, norm, nums) AS class FROM g WHERE len(s) > 0)"""
_PAIRS = """p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) AS na, len(b.s) AS nb, least(length(a.norm), length(b.norm)) AS chars, len(a.nums) AS ka, len(b.nums) AS kb, len(list_intersect(a.nums, b.nums)) AS k
        FROM {rows} a JOIN {rows} b ON a.panel = b.panel AND a.id < b.id AND abs(a.date - b.date) <= 2),
    q AS (SELECT a, b, i::DOUBLE / (na + nb - i) AS jaccard, i::DOUBLE / least(na, nb) AS containment FROM p
        WHERE (i::DOUBLE / (na + nb - i) >= 0.5 OR (i::DOUBLE / least(na, nb) >= 0.62 AND chars >= 20)) AND NOT (ka > 0 AND kb > 0 AND k::DOUBLE / greatest(ka + kb - k, 1) < 0.5))"""


@register("news30", f"{_STORIES} SELECT id, class FROM m")
def near_dup_membership(spark, sf):
    return dedup.near_dup_classes(dedup.headline_keys(dedup.dealt(news(spark, sf, 30))))[0].select("id", "class")


@register("news30", f"{_STORIES}, f AS (SELECT * FROM m WHERE id = class), {_PAIRS.format(rows='f')} SELECT a, b, round(jaccard, 6) AS jaccard, round(containment, 6) AS containment FROM q")
def near_dup_class_pairs(spark, sf):
    """Pairs of classes: with near_dup_membership, all that near_dup_pairs writes out."""
    return dedup.near_dup_classes(dedup.headline_keys(dedup.dealt(news(spark, sf, 30))))[1].select("a", "b", F.round("jaccard", 6).alias("jaccard"), F.round("containment", 6).alias("containment"))


#: Rows one by one in id order, with the list of those that stayed.
ORACLE_SQL["near_dup_survivors"] = "WITH RECURSIVE " + with_views(
    "news30",
    f"""{_STORIES}, {_PAIRS.format(rows='m')},
    old AS (SELECT DISTINCT CASE WHEN a % 3 = 0 THEN b ELSE a END AS id FROM q WHERE (a % 3 = 0) <> (b % 3 = 0)),
    fresh AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM news WHERE id % 3 <> 0 AND id NOT IN (SELECT id FROM old)),
    before AS (SELECT fresh.id, i, coalesce((SELECT list(a) FROM q WHERE q.b = fresh.id AND a % 3 <> 0), []) AS early FROM fresh),
    walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS stays UNION ALL
        SELECT before.i, CASE WHEN list_has_any(stays, early) THEN stays ELSE list_append(stays, before.id) END FROM walk JOIN before ON before.i = walk.i + 1)
    SELECT id, panel, title FROM news WHERE id IN (SELECT unnest(stays) FROM (SELECT stays FROM walk ORDER BY i DESC LIMIT 1))""",
).removeprefix("WITH ")


# --- claims on links -------------------------------------------------------------------------------------------


def _claiming(df):
    """Documents as rows that claim one of 50 links, over a year."""
    i = F.col("doc_id")
    return df.select(
        i.alias("id"), F.col("lang").alias("panel"), F.concat(F.lit("https://a.co/news/1234"), i % 50).alias("url"),
        F.concat(F.lit("one two three four five six seven eight "), F.element_at(F.split("text", "\n", 2), 1)).alias("title"), F.date_add(F.lit("2024-01-01").cast("date"), (i % 365).cast("int")).alias("date"),
    ).where("panel is not null and title is not null")


_CLAIMS = "WITH RECURSIVE " + with_views(
    "news",
    f""", n AS (SELECT id, panel, 'https://a.co/news/1234' || (id % 50) AS url, 'one two three four five six seven eight ' || title AS title, date FROM news WHERE panel IS NOT NULL AND title IS NOT NULL),
    d AS (SELECT panel, url, date, min(id) AS id FROM n GROUP BY ALL),
    o AS (SELECT panel, url, min(date) AS date FROM d GROUP BY ALL UNION ALL SELECT * FROM (SELECT o.panel, o.url, min(d.date) AS date FROM o JOIN d ON d.panel = o.panel AND d.url = o.url AND d.date > o.date + 30 GROUP BY ALL)),
    w AS (SELECT d.*, lead(date) OVER (PARTITION BY panel, url ORDER BY date) AS until FROM o JOIN d USING (panel, url, date)),
    f AS (SELECT n.id, n.url, n.title, w.id AS owner, t.title AS ft FROM n JOIN w ON w.panel = n.panel AND w.url = n.url AND n.date >= w.date AND (until IS NULL OR n.date < until) JOIN n AS t ON t.id = w.id)
    SELECT id, CASE WHEN id = owner OR {rule_sql.same_story('title', 'ft', text.STORY_STOP)} THEN url END AS url_kept FROM f""",
).removeprefix("WITH ")


@register(None, _CLAIMS)
def link_claims(spark, sf):
    return audits.claims_in_order(_claiming(table(spark, sf, "documents")))[0].select("id", "url_kept")


@register(None, _CLAIMS)
def link_claims_stream(spark, sf):
    """The same as a stream: files of the table in micro-batches, claims in a table between them."""
    kept = Kept(spark, "claim-stream")
    documents = table(spark, sf, "documents")
    stream = spark.readStream.schema(documents.schema).parquet(f"{sf}/documents.parque[t]")  # as a pattern it may be a file or a folder
    jobs.claim_stream(_claiming(stream), f"{kept.base}/claims", f"{kept.base}/out", f"{kept.base}/checkpoint").awaitTermination()
    return spark.read.schema("id long, url_kept string").parquet(f"{kept.base}/out").select("id", "url_kept")


# --- publishers ------------------------------------------------------------------------------------------------

_HOSTS = list(publishers.NAMES)
_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_AT = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
_PLACES = ["", "www.", "m.", "news.th."]


def _placed(spark, sf):
    """Pages on known hosts, their sub-domains and unknown ones, labelled with their own publisher's name, another's or several."""
    i = F.col("id")
    host = F.when(i % 7 == 0, links.host_of(F.col("url"))).otherwise(F.concat(_AT(_PLACES, i), _AT(_HOSTS, F.floor(i / 2))))
    first = [names[0] for names in publishers.NAMES.values()]
    own = _AT(first, F.floor(i / 2))
    label = F.when(i % 5 == 0, own).when(i % 5 == 1, F.concat(own, F.lit(" on MSN"))).when(i % 5 == 2, _AT(first, i + 7)).when(i % 5 == 3, F.concat(F.lit("Paper X / "), own)).otherwise("** Paper X")
    return crawl(spark, sf).select("id", host.alias("host"), label.alias("source_label"), F.concat(F.lit("https://"), host, F.lit("/a/12345")).alias("link"))


_PLACED = f""", l AS (SELECT id, CASE WHEN id % 7 = 0 THEN {rule_sql.host('url')} ELSE list_extract({_LIST(_PLACES)}, CAST(id % {len(_PLACES)} + 1 AS INTEGER)) || list_extract({_LIST(_HOSTS)}, CAST(id // 2 % {len(_HOSTS)} + 1 AS INTEGER)) END AS host,
        list_extract({_LIST([n[0] for n in publishers.NAMES.values()])}, CAST(id // 2 % {len(_HOSTS)} + 1 AS INTEGER)) AS own, list_extract({_LIST([n[0] for n in publishers.NAMES.values()])}, CAST((id + 7) % {len(_HOSTS)} + 1 AS INTEGER)) AS other FROM crawl),
    k AS (SELECT unnest({_LIST(_HOSTS)}) AS parent, unnest([{', '.join(_LIST(n) for n in publishers.NAMES.values())}]) AS names),
    h AS (SELECT id, regexp_replace(host, '^www\\.', '') AS host, own, other, CASE id % 5 WHEN 0 THEN [own] WHEN 1 THEN [own] WHEN 2 THEN [other] WHEN 3 THEN ['Paper X', own] ELSE ['Paper X'] END AS credits FROM l),
    b AS (SELECT h.*, parent, names FROM h LEFT JOIN k ON h.host = parent OR ends_with(h.host, '.' || parent) QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(parent) DESC NULLS LAST) = 1)"""


@register("crawl", f"{_PLACED} SELECT id, names[1] AS publisher FROM b")
def publisher_names(spark, sf):
    return publishers.publisher_of(_placed(spark, sf), publishers.alias_table(spark))


_SQUASH = lambda c: f"regexp_replace(replace(lower({c}), '&', 'and'), '[^a-z0-9\\x{{0E00}}-\\x{{0E7F}}]+', '', 'g')"


@register("crawl", f"""{_PLACED}, c AS (SELECT *, unnest(credits) AS label FROM b), w AS (SELECT *, split_part(coalesce(parent, host), '.', 1) AS word FROM c),
    v AS (SELECT id, CASE WHEN contains(lower(label), word) OR contains({_SQUASH('label')}, {_SQUASH('word')}) OR len(list_filter(names, lambda a: CASE WHEN regexp_matches(a, '[\\x{{0E00}}-\\x{{0E7F}}]') THEN contains(label, a) ELSE contains({_SQUASH('label')}, {_SQUASH('a')}) END)) > 0 THEN 3
        WHEN len(list_filter({_LIST(publishers.CARRIERS)}, lambda x: host = x OR ends_with(host, '.' || x))) > 0 THEN 2 WHEN parent IS NOT NULL THEN 0 ELSE 1 END AS r FROM w)
    SELECT id, ['mismatch', 'unknown', 'syndicated', 'match'][max(r) + 1] AS verdict FROM v GROUP BY id""")
def publisher_verdicts(spark, sf):
    """Labels against hosts by the whole table of publishers and carriers."""
    from tallyroom.operators.linkjobs import label_host_verdict

    return label_host_verdict(_placed(spark, sf), publishers.alias_table(spark), publishers.carrier_table(spark), url="link")


_NAMES = sorted({a for names in publishers.NAMES.values() for a in names})
_GENERIC_TITLE = f"CASE id % 6 WHEN 0 THEN upper(list_extract({_LIST(_NAMES)}, CAST(id // 6 % {len(_NAMES)} + 1 AS INTEGER))) WHEN 1 THEN 'bangkok post -' WHEN 2 THEN split_part(host, '.', 1) WHEN 3 THEN 'Set' WHEN 4 THEN ' | ' ELSE title END"


@register("crawl", f""", l AS (SELECT id, {rule_sql.host('url')} AS host, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM crawl), t AS (SELECT id, host, {_GENERIC_TITLE} AS t FROM l)
    SELECT id, CASE WHEN id % 6 < 5 THEN true ELSE length(trim(t)) <= 4 OR regexp_replace(lower(t), '[^a-z0-9]', '', 'g') = regexp_replace(split_part(host, '.', 1), '[^a-z0-9]', '', 'g') OR lower(trim(t)) IN (SELECT lower(unnest({_LIST(_NAMES)})))
        OR lower(trim(t)) IN (SELECT unnest({_LIST(audits.GENERIC)})) END AS generic FROM t""")
def generic_titles(spark, sf):
    """Titles that are a publisher's or the site's own name, a short word or a bare separator, and pages' own."""
    i, host = F.col("id"), links.host_of(F.col("url"))
    own = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    title = F.when(i % 6 == 0, F.upper(_AT(_NAMES, F.floor(i / 6)))).when(i % 6 == 1, "bangkok post -").when(i % 6 == 2, F.element_at(F.split(host, r"\."), 1)).when(i % 6 == 3, "Set").when(i % 6 == 4, " | ").otherwise(own)
    return crawl(spark, sf).select("id", audits.is_generic_title(title, host).alias("generic"))


# --- relevance -------------------------------------------------------------------------------------------------

_WORDS = [w for w, _ in (*rules.DIRECT_BOOSTS, *rules.BOOSTS)] + rules.DROP_TICKERS + rules.DROP_BRANDS + rules.DROP_WORDS


def _spoken(spark, sf):
    """News titles behind two words of the tables, some in another case and some inside longer words."""
    i = F.col("id")
    first, second = _AT(_WORDS, i), _AT(_WORDS, F.floor(i / 3))
    words = F.when(i % 4 == 0, F.lower(first)).when(i % 4 == 1, F.concat(first, F.lit("x"))).otherwise(first)
    return news(spark, sf).select("id", F.concat_ws(" ", words, second, "title").alias("title"))


_SPOKEN = f""", s AS (SELECT id, list_extract({_LIST(_WORDS)}, CAST(id % {len(_WORDS)} + 1 AS INTEGER)) AS x, list_extract({_LIST(_WORDS)}, CAST(id // 3 % {len(_WORDS)} + 1 AS INTEGER)) AS y, title FROM news),
    t AS (SELECT id, concat_ws(' ', CASE id % 4 WHEN 0 THEN lower(x) WHEN 1 THEN x || 'x' ELSE x END, y, title) AS t FROM s)"""
_BOOSTED = lambda boosts: "list_sum([0] || [CASE WHEN contains(lower(t), x.w) THEN x.b ELSE 0 END for x in [" + ", ".join(f"{{'w': '{w.lower()}', 'b': {b}}}" for w, b in boosts) + "]])"


@register("news", f"""{_SPOKEN}, d AS (SELECT id, {_BOOSTED(rules.DIRECT_BOOSTS)} AS direct, {_BOOSTED(rules.BOOSTS)} AS other,
        {rule_sql.test('t', rules.whole_word(rules.DROP_TICKERS))} OR {rule_sql.test('t', rules.whole_word(rules.DROP_BRANDS, '(?i)'))} OR {rule_sql.has_any('lower(t)', [w.lower() for w in rules.DROP_WORDS])} AS dropped FROM t)
    SELECT id, CAST(CASE WHEN dropped AND direct = 0 THEN 0 ELSE 5 + direct + other END AS INTEGER) AS score FROM d""")
def sector_relevance(spark, sf):
    return _spoken(spark, sf).select("id", rules.relevance_score(F.col("title"), 5).alias("score"))


@register("news", f"{_SPOKEN}, k AS (SELECT DISTINCT unnest({_LIST(_WORDS)}) AS keyword) SELECT id, keyword FROM t JOIN k ON contains(lower(t), lower(keyword))")
def keyword_hits(spark, sf):
    """The same words as a dictionary that is joined."""
    words = spark.createDataFrame([(w,) for w in dict.fromkeys(_WORDS)], "keyword string")
    return feed.keyword_hits(_spoken(spark, sf), words).select("id", "keyword")


# --- pages and records -----------------------------------------------------------------------------------------

#: Where a JSON-LD block holds its headline; %s is the headline, as JSON.
_LD = [
    '{"@type": "NewsArticle", "headline": %s}',
    '[{"@type": "Organization", "name": "Site"}, {"headline": %s}]',
    '{"@graph": [{"@type": "WebSite", "name": "Site"}, {"@type": ["Thing", "BlogPosting"], "name": %s}]}',
    '{"@type": "ItemList", "itemListElement": [{"mainEntityOfPage": {"mainEntity": [[{"headline": %s}]]}}, {"headline": "later"}]}',
    '{"headline": 7, "mainEntity": {"headline": %s}}',
    '{"mainEntity": {"mainEntity": {"mainEntity": {"mainEntity": {"mainEntity": {"mainEntity": {"mainEntity": {"headline": %s}}}}}}}}',
    'not json %s',
]


@register("crawl", r"SELECT id, CASE WHEN id % 7 < 5 THEN trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\s]+', ' ', 'g')) END AS headline FROM crawl")
def json_ld_headlines(spark, sf):
    """Pages with their own titles blended into blocks of every shape; the last two hold none that counts (too deep, not JSON)."""
    title = F.trim(F.regexp_replace(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    quoted = F.concat(F.lit('"'), F.replace(F.replace(title, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    block = F.format_string("<script type='application/ld+json'>%s</script>", F.replace(_AT(_LD, F.col("id")), F.lit("%s"), quoted))
    return crawl(spark, sf).select("id", feeds.json_ld_headline(F.concat(F.lit('<script type="application/ld+json">{"name": "Site"}</script>'), block, "html")).alias("headline"))


@register("crawl", f"""{CRAWL_LINKS}, t AS (SELECT id, link, regexp_extract(crawl.html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM crawl JOIN l USING (id)), s AS (SELECT *, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS head FROM t WHERE trim(title) <> '')
    SELECT id, id % 3 < 2 AS repaired, CASE WHEN id % 3 < 2 THEN head ELSE title END AS title, CASE id % 3 WHEN 0 THEN 'of ' || id || chr(10) || 'two lines' WHEN 1 THEN 'own' END AS summary,
        CASE WHEN id % 3 = 0 AND {rule_sql.link_safety('link')} = 'ok' OR id % 3 = 0 THEN {rule_sql.canonical_url('link')} WHEN id % 3 = 1 THEN 'https://own.co/1' ELSE '' END AS url FROM s""")
def repaired_records(spark, sf):
    """Pages' titles that swallowed their record, with and without fields of their own, and whole ones."""
    i = F.col("id")
    own = crawl(spark, sf).select("id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title")).where("trim(title) <> ''")
    head = F.trim(F.regexp_replace("title", r"\s+", " "))
    record = F.concat(F.lit("["), head, F.lit("] SUMMARY: [of "), i.cast("string"), F.lit("\ntwo lines] URL: "), "link", F.lit(", SOURCE: Paper"))
    rows = own.join(crawl_links(spark, sf).select("id", "link"), "id")
    rows = rows.select("id", F.when(i % 3 < 2, record).otherwise(F.col("title")).alias("title"), F.when(i % 3 == 1, "own").alias("summary"), F.when(i % 3 == 1, "https://own.co/1").otherwise("").alias("url"))
    return feeds.repair_records(rows).select("id", "repaired", "title", "summary", "url")


@register("crawl", f"{CRAWL_LINKS} SELECT id, CASE WHEN id % 4 = 3 THEN '' ELSE {rule_sql.canonical_url('link')} END AS url FROM l")
def stored_urls(spark, sf):
    """Links with prose, a second link or a bracket behind them and odd capitals, and what is no link at all."""
    k = F.col("id") % 4
    raw = F.when(k == 0, F.concat(F.lit("  "), "link", F.lit("), see there"))).when(k == 1, F.concat("link", F.lit(" / https://b.co/2"))).when(k == 2, F.concat(F.upper(F.substring("link", 1, 4)), F.substring("link", 5, 10_000), F.lit(";."))).otherwise(F.concat(F.lit("see "), "link"))
    return crawl_links(spark, sf).select("id", links.stored_url(raw).alias("url"))


_RUN = r"""regexp_replace(lower({}), '[^a-z0-9\x{{0E00}}-\x{{0E7F}}]', '', 'g')"""


@register("crawl", f""", t AS (SELECT id, {_RUN.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS t FROM crawl), p AS (SELECT x.id, CASE WHEN length(x.t) <= length(y.t) THEN x.t ELSE y.t END AS s, CASE WHEN length(x.t) <= length(y.t) THEN y.t ELSE x.t END AS l FROM t x JOIN t y ON y.id = x.id + 1),
    r AS (SELECT id, s, max(CASE WHEN contains(l, substr(s, i, k)) THEN k ELSE 0 END) AS k FROM (SELECT id, s, l, i, unnest(range(1, length(s) - i + 2)) AS k FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM p)) GROUP BY ALL)
    SELECT p.id, round(CASE WHEN p.s = '' THEN 0 ELSE coalesce(k, 0)::DOUBLE / length(p.s) END, 6) AS containment FROM p LEFT JOIN r USING (id)""")
def lcs_containments(spark, sf):
    """Whole titles of neighbouring pages."""
    t = crawl(spark, sf).select("id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("t"))
    pairs = t.select("id", F.col("t").alias("a")).join(t.select((F.col("id") - 1).alias("id"), F.col("t").alias("b")), "id")
    return audits.lcs_containment(pairs).select("id", F.round("containment", 6).alias("containment"))
