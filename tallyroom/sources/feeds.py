"""Scans of chart payloads, feeds and record blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.functions import links
from tallyroom.functions.dates import first_date
from tallyroom.functions.text import clean_markup

CHART = """chart struct<result: array<struct<meta: struct<symbol: string, regularMarketPrice: double, regularMarketTime: long>, timestamp: array<long>,
    indicators: struct<quote: array<struct<close: array<double>, volume: array<double>>>, adjclose: array<struct<adjclose: array<double>>>>>>>"""
#: Fields of a record block, and their values.
FIELDS = ["CATEGORY", "HEADLINE", "SUMMARY", "IMPACT_LEVEL", "SOURCE", "URL", "DATE", "EVENT_DATE", "PUBLISH_DATE", "CONFIDENCE"]
MARKER = r"\s*\[?(?<![A-Za-z0-9_])(?:" + "|".join(FIELDS) + r")\s*:"


def read_chart_json(spark: SparkSession, path: str) -> DataFrame:
    """ticker, date, close, volume, ts from payloads with parallel arrays. The adjusted close wins, rows without a close drop out, a missing volume is 0, the date is UTC's."""
    r = spark.read.schema(CHART).option("multiLine", True).json(path).select(F.explode("chart.result").alias("r"))
    quote, adjusted = F.col("r.indicators.quote")[0], F.col("r.indicators.adjclose")[0]["adjclose"]
    rows = r.select(F.col("r.meta.symbol").alias("ticker"), F.posexplode("r.timestamp").alias("i", "ts"), quote.alias("q"), adjusted.alias("a"))
    close = F.coalesce(F.get("a", F.col("i")), F.get("q.close", F.col("i")))
    out = rows.select("ticker", F.to_date(F.timestamp_seconds("ts")).alias("date"), close.alias("close"), F.coalesce(F.get("q.volume", F.col("i")), F.lit(0.0)).alias("volume"), "ts")
    return out.where("close is not null")


def read_feed_xml(spark: SparkSession, path: str) -> DataFrame:
    """title, link, published, guid, source of each item; a source stands under either of two tags."""
    schema = "title string, link string, pubDate string, guid string, source string, `News:Source` string"
    items = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", False).schema(schema).load(path)
    stamp = F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    return items.select(clean_markup(F.col("title")).alias("title"), F.trim("link").alias("link"), stamp.alias("published"), "guid", F.coalesce("source", "News:Source").alias("source"))


def field(block: Column, key: str) -> Column:
    """The value after KEY:, cut at the next marker on its line; null if there is none."""
    line = F.regexp_extract(block, rf"(?<![A-Za-z0-9_]){key}:[ \t]*([^\n]+)", 1)
    return F.nullif(F.trim(F.regexp_replace(line, MARKER + "[^\n]*$", "")), F.lit(""))


def enum(c: Column, allowed: list[str], otherwise: str) -> Column:
    """First token without brackets, in capitals; otherwise where it isn't allowed."""
    token = F.upper(F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\[\]]", " "), r"([^\s|]+)", 1))
    return F.when(token.isin(allowed), token).otherwise(otherwise)


def explode_records(completions: DataFrame, text: str = "text") -> DataFrame:
    """One row per record block: texts are split on ---, and where a part holds several headlines, before each line that starts with CATEGORY:."""
    several = lambda p: F.size(F.regexp_extract_all(p, F.lit("HEADLINE:"), F.lit(0))) > 1
    parts = F.flatten(F.transform(F.split(text, "---"), lambda p: F.when(several(p), F.split(p, r"\n(?=CATEGORY:)")).otherwise(F.array(p))))
    rows = completions.select("*", F.posexplode(parts).alias("block_no", "block"))
    return rows.where(F.trim("block") != "")


def load_records(completions: DataFrame, categories: list[str], run_date) -> DataFrame:
    """Feed rows of all record blocks: dates event, publish, stated, then the run's; values outside their lists fall to MACRO and MEDIUM; rows without a headline drop out."""
    rows = explode_records(completions)
    b = F.col("block")
    level = enum(field(b, "IMPACT_LEVEL"), ["HIGH", "MEDIUM", "LOW"], "MEDIUM")
    confidence = F.lower(field(b, "CONFIDENCE"))
    url = F.coalesce(F.nullif(F.regexp_extract(field(b, "URL"), r"(https?://[^\s\[\]]+)", 1), F.lit("")), field(b, "URL"))
    date = first_date(*(F.coalesce(field(b, k), F.lit("")) for k in ("EVENT_DATE", "PUBLISH_DATE", "DATE")))
    return rows.select(
        "id", "block_no", enum(field(b, "CATEGORY"), categories, "MACRO").alias("category"), field(b, "HEADLINE").alias("headline"), field(b, "SUMMARY").alias("summary"), level.alias("impact_level"),
        F.lower(level).alias("severity"), field(b, "SOURCE").alias("source"), url.alias("url"), F.when(confidence.isin("high", "medium", "low"), confidence).alias("confidence"), F.coalesce(date, F.lit(run_date).cast("date")).alias("date"),
    ).where("headline is not null")


def repair_blob_title(title: Column) -> Column:
    """What stands before the first marker in a title that swallowed its record, without the bracket that the marker's own leaves."""
    return _unbracketed(F.regexp_replace(title, "(?s)" + MARKER + ".*$", ""))


def _unbracketed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"^\[|\]$", ""))


def swallowed(title: Column, key: str) -> Column:
    """The value of a field inside a title, over line ends up to the next marker; null if there is none."""
    value = F.regexp_extract(title, rf"(?s)(?<![A-Za-z0-9_]){key}\s*:\s*(.+)", 1)
    return F.nullif(_unbracketed(F.regexp_replace(value, "(?s)" + MARKER + ".*$", "")), F.lit(""))


def repair_records(rows: DataFrame) -> DataFrame:
    """rows (title, summary, url) whose titles hold a whole record, mended: the headline alone, and the summary and link rescued from
    the title where the row has none of its own. Other rows, and titles with nothing before the marker, stay as they are; repaired tells."""
    headline = repair_blob_title(F.col("title"))
    broken = links.is_blob_title(F.col("title")) & (headline != "") & (headline != F.col("title"))
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    link = F.nullif(links.stored_url(swallowed(F.col("title"), "URL")), F.lit(""))
    mended = {"title": headline, "summary": F.coalesce(empty("summary"), swallowed(F.col("title"), "SUMMARY")), "url": F.coalesce(empty("url"), link, F.col("url"))}
    broken = F.coalesce(broken, F.lit(False))
    return rows.withColumns({**{c: F.when(broken, v).otherwise(F.col(c)) for c, v in mended.items()}, "repaired": broken})


#: What of a JSON-LD node may hold the article, what kinds of nodes are articles by name, and how deep it may lie.
LD_INNER = ["@graph", "mainEntity", "mainEntityOfPage", "itemListElement"]
LD_ARTICLE = "(?i)Article|BlogPosting"
LD_DEPTH = 6


def json_ld_headline(html: Column) -> Column:
    """The first headline (or name of an article) in a page's JSON-LD blocks, in reading order and down to LD_DEPTH; null without one.

    Blocks become variants. Each step puts the inner nodes of every node without a headline in its place, so that
    what stands first stays first: lists, graphs and nested objects in any mix. Blocks that don't parse are passed over.
    """
    named = lambda v, k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$['{k}']", "variant")) == "STRING", F.nullif(F.trim(F.try_variant_get(v, f"$['{k}']", "string")), F.lit("")))
    node = lambda v: F.struct(F.lit(None).cast("string").alias("t"), v.alias("v"))

    def opened(x: Column) -> Column:
        v = x["v"]
        kind = F.to_json(F.try_variant_get(v, "$['@type']", "variant"))
        t = F.coalesce(named(v, "headline"), F.when(kind.rlike(LD_ARTICLE), named(v, "name")))
        inner = F.filter(F.array(*(F.try_variant_get(v, f"$['{k}']", "variant") for k in LD_INNER)), lambda y: y.isNotNull())
        found = F.array(F.struct(t.alias("t"), v.alias("v")))
        items = F.try_variant_get(v, "$", "array<variant>")
        return F.when(x["t"].isNotNull(), F.array(x)).when(items.isNotNull(), F.transform(items, node)).when(t.isNotNull(), found).otherwise(F.transform(inner, node))

    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    nodes = F.filter(F.transform(blocks, lambda b: node(F.try_parse_json(b))), lambda x: x["v"].isNotNull())
    for _ in range(LD_DEPTH + 1):
        nodes = F.flatten(F.transform(nodes, opened))
    return F.get(F.filter(nodes, lambda x: x["t"].isNotNull()), 0)["t"]


def page_title(html: Column) -> Column:
    """Title of a page and where it came from: Open Graph, Twitter, JSON-LD, title, first heading."""
    attr = lambda name, key: F.coalesce(*(F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in (rf"(?is)<meta[^>]+{name}=[\"']{key}[\"'][^>]+content=[\"']([^\"']+)", rf"(?is)<meta[^>]+content=[\"']([^\"']+)[\"'][^>]+{name}=[\"']{key}[\"']")))
    headline = F.when(F.contains(html, F.lit("ld+json")), json_ld_headline(html))
    tag = lambda t: F.nullif(clean_markup(F.regexp_extract(html, rf"(?is)<{t}[^>]*>(.*?)</{t}>", 1)), F.lit(""))
    steps = [("og", attr("property", "og:title")), ("twitter", attr("name", "twitter:title")), ("json_ld", headline), ("title", tag("title")), ("h1", tag("h1"))]
    return F.coalesce(*(F.when(c.isNotNull(), F.struct(clean_markup(c).alias("title"), F.lit(k).alias("origin"))) for k, c in steps))


def published_date(html: Column, url: Column) -> Column:
    """Date of a page: JSON-LD, then meta tags, then a time tag, then a dated path; only between 2000 and 2100."""
    found = [
        F.regexp_extract(html, r"\"datePublished\"\s*:\s*\"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1),
        F.regexp_extract(html, r"(?i)<meta[^>]+(?:article:published_time|pubdate|publish-date)[^>]+content=[\"']([0-9]{4}-[0-9]{2}-[0-9]{2})", 1),
        F.regexp_extract(html, r"(?i)<time[^>]+datetime=[\"']([0-9]{4}-[0-9]{2}-[0-9]{2})", 1),
        F.regexp_replace(F.regexp_extract(url, r"/([0-9]{4}/[0-9]{2}/[0-9]{2})(?:/|$)", 1), "/", "-"),
    ]
    good = [F.try_to_date(F.nullif(f, F.lit("")), "yyyy-MM-dd") for f in found]
    return F.coalesce(*(F.when(F.year(g).between(2000, 2100), g) for g in good))


def section(text: Column, key: str) -> Column:
    """A field's value of several lines: up to the next line that starts with a key in capitals; '' without the field."""
    return F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), rf"{key}:\s*((?s:.*?))(?=\n[A-Z_]+:|\z)", 1), r"^\s+|\s+$", ""))


def bullets(c: Column) -> Column:
    """Bullets on lines of their own; a single line is split at bullet signs, or else at spaced dashes."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    clean = lambda parts: F.array_join(F.filter(F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(x, r"^[-•\s]+", ""), r"\s+$", "")), lambda x: x != ""), "\n")
    return F.when(F.contains(text, F.lit("\n")), text).when(F.contains(text, F.lit("•")), clean(F.split(text, "•"))).when(text.rlike(r"\s+-\s+"), clean(F.split(text, r"\s+-\s+"))).otherwise(text)


def tone(c: Column) -> Column:
    """bullish, bearish or neutral, by how the value begins."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(F.startswith(low, F.lit("bull")), "bullish").when(F.startswith(low, F.lit("bear")), "bearish").otherwise("neutral")
