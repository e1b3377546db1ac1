"""Feed reads and reports: filters, pins, counters, top rows, digests, fan-out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.functions import dates, links, rules, text


def feed_filter(df: DataFrame, panel: str | None = None, category: str | None = None, since=None) -> DataFrame:
    """Visible rows."""
    out = df.where("not hidden")
    if panel is not None:
        out = out.where(F.col("panel") == panel)
    if category is not None:
        out = out.where(F.col("category") == category)
    return out if since is None else out.where(F.col("date") >= F.lit(since).cast("date"))


def pin_filter(df: DataFrame, since=None, until=None) -> DataFrame:
    out = df.where(F.coalesce("show_pin", F.lit(False)) | F.coalesce("chart_marked", F.lit(False)))
    out = out if since is None else out.where(F.col("date") >= F.lit(since).cast("date"))
    return out if until is None else out.where(F.col("date") <= F.lit(until).cast("date"))


def default_pin(df: DataFrame) -> DataFrame:
    """An explicit flag wins, else high severity pins."""
    return df.withColumn("show_pin", F.coalesce("show_pin", F.col("severity") == "high"))


def repair_pins(df: DataFrame) -> DataFrame:
    """High rows that are not pinned get their pin; repaired says which."""
    wrong = (F.col("severity") == "high") & F.coalesce(F.col("show_pin") == F.lit(False), F.lit(False))
    return df.withColumns({"repaired": wrong, "show_pin": F.when(wrong, True).otherwise(F.col("show_pin"))})


def age_cutoff(df: DataFrame, days: int, now) -> DataFrame:
    return df.where(F.col("date") >= F.date_sub(F.lit(now).cast("date"), days))


def recap_gate(df: DataFrame, today, hours: int = 48, col: str = "date") -> DataFrame:
    """gate: kept where the event date is null or in the last hours up to today, else stale; future dates are stale too."""
    age = F.datediff(F.lit(today).cast("date"), F.col(col))
    return df.withColumn("gate", F.when(F.col(col).isNull() | ((age >= 0) & (age * 24 <= hours)), "kept").otherwise("stale"))


def mention_gate(items: DataFrame, company: Column, broker: Column, require: str = "require_mention") -> DataFrame:
    """Rows that their query's demand lets through: 'this', 'this or broker', or none. Severity high falls to medium where only the broker is named."""
    need = F.col(require)
    passes = need.isNull() | company | ((need == "or_broker") & broker)
    only_broker = (need == "or_broker") & ~company
    return items.where(passes).withColumn("severity", F.when(only_broker & (F.col("severity") == "high"), "medium").otherwise(F.col("severity")))


# --- top rows --------------------------------------------------------------------------------------------------


def feed_top(df: DataFrame, n: int = 100) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("display_priority"), F.desc("date"), F.desc("id")).limit(min(max(n, 1), 500))


def pin_timeline(df: DataFrame, n: int = 5_000) -> DataFrame:
    return pin_filter(df).orderBy("date", F.desc_nulls_last("display_priority"), "id").limit(min(max(n, 1), 20_000))


def day_rows(df: DataFrame, date, n: int = 500) -> DataFrame:
    rows = df.where((F.col("date") == F.lit(date).cast("date")) & ~F.col("hidden"))
    return rows.orderBy(F.desc_nulls_last("display_priority"), F.desc("id")).limit(n)


def recheck_queue(df: DataFrame, n: int) -> DataFrame:
    """Visible rows by status, those never checked first, then the least recently checked."""
    return df.where("not hidden").orderBy(F.asc_nulls_first("status"), F.asc_nulls_first("checked_at"), "id").limit(n)


def latest_brief(df: DataFrame, key: str = "panel", value: str = "brief", at: str = "fetched_at") -> DataFrame:
    """Per key the brief refreshed last; rows without a time come last."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(at), F.desc("id"))
    return df.where(F.col(value).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


# --- counters and reports --------------------------------------------------------------------------------------


def table_metadata(daily: DataFrame, runs: DataFrame, key: str = "ticker") -> DataFrame:
    """Rows and date range per key, with the status of the latest run: empty, ok or degraded."""
    last = runs.agg(F.max_by("ok", "id").alias("last_ok"), F.max("id").alias("last_run"))
    out = daily.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    status = F.when(F.col("n") == 0, "empty").when(F.col("last_ok"), "ok").otherwise("degraded")
    return out.join(F.broadcast(last)).withColumn("status", status).drop("last_ok")


def feed_counters(news: DataFrame, today) -> DataFrame:
    fetched = dates.local_date(F.col("fetched_at")) == F.lit(today).cast("date")
    return news.groupBy("panel").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("display_priority") >= 75).alias("urgent"), F.count_if(fetched).alias("fetched_today")
    )


def last_runs(runs: DataFrame, sources: list[str]) -> DataFrame:
    """Latest run of each listed source, null for those that never ran: one aggregation."""
    wanted = runs.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    latest = runs.where(F.col("source").isin(sources)).groupBy("source").agg(F.max_by(F.struct("id", "started_at", "ok", "rows_added"), "id").alias("r"))
    return F.broadcast(wanted).join(latest, "source", "left").select("source", "r.*")


def quality_report(news: DataFrame, today, url: str = "source_url") -> DataFrame:
    """Overlapping counts over visible rows, in one pass."""
    u = F.col(url)
    return news.where("not hidden").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(u.isNull() | (u == "")).alias("no_link"),
        F.count_if(u.rlike(links.REDIRECT)).alias("redirect_links"),
        F.count_if(links.is_malformed_link(u)).alias("malformed_links"),
        F.count_if(links.is_blob_title(F.col("title"))).alias("blob_titles"),
        F.count_if(dates.is_fabricated_date(F.col("date"), today)).alias("fabricated_dates"),
        F.count_if(F.col("date") > F.lit(today).cast("date")).alias("future_dates"),
        F.count_if((F.col("severity") == "high") & ~F.coalesce("show_pin", F.lit(False))).alias("unpinned_high"),
    )


def category_counts(news: DataFrame) -> DataFrame:
    return news.groupBy("panel", "category").agg(F.count(F.lit(1)).alias("n"))


def category_impact(news: DataFrame) -> DataFrame:
    return news.groupBy("category").pivot("impact", ["positive", "negative", "neutral"]).count().na.fill(0)


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))


def yearly_linked(news: DataFrame, url: str = "source_url") -> DataFrame:
    return news.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if(links.is_usable_link(F.col(url))).alias("linked"))


def pinned_days(news: DataFrame) -> DataFrame:
    """Days with a pin per year, as they are and after the repair of pins."""
    fixed = repair_pins(news.withColumn("before", F.coalesce("show_pin", F.lit(False))))
    return fixed.groupBy(F.year("date").alias("year")).agg(
        F.count_distinct(F.when(F.col("before"), F.col("date"))).alias("days_before"), F.count_distinct(F.when(F.coalesce("show_pin", F.lit(False)), F.col("date"))).alias("days_after")
    )


def duplicate_groups(news: DataFrame, key: Column) -> DataFrame:
    return news.groupBy("panel", key.alias("title_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def status_diff(before: DataFrame, after: DataFrame, col: str = "status") -> DataFrame:
    """Counts by status before and after."""
    count = lambda df, name: df.groupBy(col).agg(F.count(F.lit(1)).alias(name))
    out = count(before, "before").join(count(after, "after"), col, "full_outer").na.fill(0, ["before", "after"])
    return out.withColumn("change", F.col("after") - F.col("before"))


def collapse_tags(items: DataFrame, key: str = "title_hash", tag: str = "panel", seq: str = "id") -> DataFrame:
    """First row of each key, with the tags of all its rows in one sorted array."""
    rest = [c for c in items.columns if c not in (key, tag)]
    out = items.groupBy(key).agg(F.min_by(F.struct(*rest), seq).alias("r"), F.sort_array(F.collect_set(tag)).alias("tags"))
    return out.select(key, "r.*", "tags")


def insert_summary(news: DataFrame) -> DataFrame:
    """Counts by category and by impact, both from one pass."""
    out = news.groupingSets([["category"], ["impact"]], "category", "impact").agg(F.count(F.lit(1)).alias("n"), F.grouping("category").alias("_g"))
    return out.select(F.when(F.col("_g") == 0, "category").otherwise("impact").alias("kind"), F.coalesce("category", "impact").alias("value"), "n")


def digest_blocks(news: DataFrame, top: int = 6) -> DataFrame:
    """Per panel, date and category the top rows as lines, and how many rows there are."""
    rows = news.where("not hidden").withColumn("category", F.coalesce("category", F.lit("MACRO")))
    w = Window.partitionBy("panel", "date", "category").orderBy(F.desc_nulls_last("display_priority"), F.desc("id"))
    ranked = rows.withColumns({"rn": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("panel", "date", "category"))})
    line = F.concat(F.lit("- "), F.col("title"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", line.alias("line")))), lambda x: x["line"]), "\n")
    return ranked.where(F.col("rn") <= top).groupBy("panel", "date", "category").agg(lines.alias("lines"), F.max("n").alias("n"))


def digest_date(news: DataFrame, date) -> DataFrame:
    """Per panel the date asked for if it has visible rows, else the latest that has."""
    asked = F.lit(date).cast("date")
    rows = news.where("not hidden").groupBy("panel").agg(F.max(F.when(F.col("date") == asked, F.col("date"))).alias("own"), F.max("date").alias("latest"))
    return rows.select("panel", F.coalesce("own", "latest").alias("date"))


def expand_by_panel(rows: DataFrame, panels: str = "panels", capped: str | None = None, category: Callable[[Column, str], Column] | None = None, named: tuple[str, ...] = ()) -> DataFrame:
    """One row per target panel; on the capped panel severity is medium at most and pins are cleared.

    category(panel, name): what a row is on one of the named panels; on others, and where it gives null, it keeps its own.
    """
    out = rows.withColumn("panel", F.explode(panels)).drop(panels)
    on_capped = F.col("panel") == F.lit(capped)
    severity = F.when(on_capped & (F.col("severity") == "high"), "medium").otherwise(F.col("severity"))
    out = out.withColumns({"severity": severity, "show_pin": F.when(on_capped, False).otherwise(F.col("show_pin"))})
    if category is None:
        return out
    return out.withColumn("category", F.coalesce(*(F.when(F.col("panel") == p, category(F.col("panel"), p)) for p in named), F.col("category")))


def coerce_category(df: DataFrame, panels: DataFrame, fallback: str = "MACRO") -> DataFrame:
    """Categories outside a panel's list become the fallback. panels: (panel, categories array)."""
    out = df.join(F.broadcast(panels.select("panel", F.col("categories").alias("_allowed"))), "panel", "left")
    good = F.coalesce(F.array_contains("_allowed", F.col("category")), F.lit(False))
    return out.withColumn("category", F.when(good, F.col("category")).otherwise(fallback)).drop("_allowed")


def rehash_survivors(news: DataFrame) -> DataFrame:
    """Per panel and recomputed hash: the row with the highest priority, then the lowest id, survives."""
    hashed = news.withColumn("title_hash", text.title_hash(F.col("title"), F.col("source_label")))
    w = Window.partitionBy("panel", "title_hash").orderBy(F.desc_nulls_last("display_priority"), "id")
    return hashed.select("id", "panel", "title_hash", (F.row_number().over(w) == 1).alias("survives"))


def batch_pins(items: DataFrame, seq: str = "id") -> DataFrame:
    """Per panel and date the first row's title as remark, and the first high row as a pin line."""
    pin = F.concat(F.lit("["), F.col("category"), F.lit("] "), F.col("title"))
    return items.groupBy("panel", "date").agg(F.min_by("title", seq).alias("remark"), F.min_by(F.when(F.col("severity") == "high", pin), F.when(F.col("severity") == "high", F.col(seq))).alias("pin"))


def top_event_type(df: DataFrame, remark: str = "remark", seq: str = "date", key: str = "ticker") -> DataFrame:
    """Per key the most frequent event class; of equals the one seen first."""
    typed = df.withColumn("event", rules.event_type(F.col(remark))).where("event is not null")
    counts = typed.groupBy(key, "event").agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first_seen"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "first_seen", "event")
    return counts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(key, "event", "n")


def actionable(df: DataFrame, statuses: list[str], forbidden: tuple[str, ...] = ("unknown", "timeout", "network_error", "rate_limited", "blocked")) -> DataFrame:
    """Rows with one of the wanted verdicts; asking for a verdict that means 'could not tell' is an error."""
    if wrong := set(statuses) & set(forbidden):
        raise ValueError(f"not verdicts to act on: {sorted(wrong)}")
    return df.where(F.col("status").isin(statuses))


def shared_urls(df: DataFrame, url: str = "url", title: str = "title") -> DataFrame:
    """Links that stand with more than one headline."""
    return df.groupBy(url).agg(F.count_distinct(title).alias("titles"), F.count(F.lit(1)).alias("n")).where("titles > 1")


def read_digest(digests: DataFrame, date=None, key: str = "panel") -> DataFrame:
    """Each panel's digest of a date, or its latest."""
    if date is not None:
        return digests.where(F.col("date") == F.lit(date).cast("date"))
    last = digests.groupBy(key).agg(F.max("date").alias("date"))
    return digests.join(last, [key, "date"], "left_semi")


def read_digests(digests: DataFrame, key: str = "panel") -> DataFrame:
    """All digests, by date."""
    return digests.orderBy(key, "date")


def reclassify(df: DataFrame, rules: list[tuple[Column, str]], otherwise: str, promotions: list[tuple[str, Column, str]] = ()) -> DataFrame:
    """category_before and category of stored rows: the first rule that holds, or otherwise; then each promotion
    (from, condition, to) in turn. Rules see the stored category, which a second run finds replaced."""
    first = F.coalesce(*(F.when(condition, F.lit(label)) for condition, label in rules), F.lit(otherwise))
    out = df.withColumn("category_before", F.col("category")).withColumn("category", first)
    for old, condition, new in promotions:
        out = out.withColumn("category", F.when((F.col("category") == old) & F.coalesce(condition, F.lit(False)), new).otherwise(F.col("category")))
    return out


def category_moves(reclassified: DataFrame) -> DataFrame:
    """Rows per stored and new category."""
    return reclassified.groupBy("category_before", "category").agg(F.count(F.lit(1)).alias("n"))


def keyword_hits(rows: DataFrame, keywords: DataFrame, title: str = "title", key: str = "id") -> DataFrame:
    """(key, keyword, and keywords' other columns): the keywords that each row's title contains, in any case, once each.

    For dictionaries of any size: keywords are looked up by their first characters (PREFIX at most), which are joined with the titles'
    distinct windows of these lengths; what is found is checked on the whole title. Empty keywords are in no title. Keys are unique.
    """
    folded = keywords.where(F.length("keyword") > 0).withColumn("_start", F.substring(F.lower("keyword"), 1, PREFIX))
    lengths = sorted(r[0] for r in folded.select(F.length("_start")).distinct().collect())  # PREFIX numbers at most
    titles = rows.select(key, F.lower(F.coalesce(title, F.lit(""))).alias("_title"))
    windows = F.array_distinct(F.flatten(F.array(*(text.ngrams(F.col("_title"), n) for n in lengths)))) if lengths else F.array().cast("array<string>")
    begun = titles.select(key, F.explode(windows).alias("_start")).join(folded, "_start").drop("_start")
    return begun.join(titles, key).where(F.contains("_title", F.lower("keyword"))).drop("_title")


#: Characters of a keyword by which it is looked up.
PREFIX = 4
