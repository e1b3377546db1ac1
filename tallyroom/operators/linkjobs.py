"""Jobs on links: labels against hosts, collisions, candidates, verdicts, re-dating, title audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.functions import classify, links, text
from tallyroom.functions.publishers import suffixes

#: Verdicts that prove a link wrong, those that say nothing, and hosts that carry others' stories.
PROVEN_WRONG = ("dead", "homepage", "unsafe", "soft_404", "mismatch")
TRANSIENT = ("blocked", "rate_limited", "unknown", "timeout", "network_error")
NOT_FOUND = r"(?i)(?<![A-Za-z0-9_])404(?![A-Za-z0-9_])|not found|page not found|ไม่พบหน้า"


def squash(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "&", "and"), r"[^a-z0-9\x{0E00}-\x{0E7F}]+", "")


def label_host_verdict(rows: DataFrame, aliases: DataFrame, syndication: DataFrame, label: str = "source_label", url: str = "url") -> DataFrame:
    """verdict of each row's label against its link's host: match, syndicated, unknown or mismatch.

    aliases: (host, alias). Hosts climb to their parents; labels that credit several get the best verdict of their parts.
    """
    host = links.host_of(F.col(url))
    climb = suffixes(host)
    credit = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(label, F.lit("")), r"^[*\s]+", ""), r"\s*[/,;|]\s*|\s+และ\s+"), F.trim), lambda x: x != "")
    parts = rows.select("id", host.alias("host"), climb.alias("hosts"), F.explode_outer(credit).alias("label"))
    known = aliases.groupBy("host").agg(F.collect_list("alias").alias("names"))
    carriers = syndication.select("host").distinct().withColumn("carrier", F.lit(True))
    each = parts.select("*", F.posexplode_outer("hosts").alias("i", "parent")).join(known.withColumnRenamed("host", "parent"), "parent", "left").join(carriers.withColumnRenamed("host", "parent"), "parent", "left")
    best = each.groupBy("id", "host", "label").agg(F.min_by(F.struct("parent", "names"), F.when(F.col("names").isNotNull(), F.col("i"))).alias("k"), F.bool_or(F.coalesce("carrier", F.lit(False))).alias("carried"))
    base = F.trim(F.regexp_replace("label", r"(?i)\s+on\s+(MSN|LINE|Flipboard|Yahoo)\s*$", ""))
    word = F.element_at(F.split(F.coalesce("k.parent", "host"), r"\."), 1)
    by_word = F.contains(F.lower(base), word) | F.contains(squash(base), squash(word))
    by_alias = F.exists("k.names", lambda a: F.when(a.rlike(r"[\x{0E00}-\x{0E7F}]"), F.contains(base, a)).otherwise(F.contains(squash(base), squash(a))))
    rank = F.when(F.col("host").isNull() | F.col("label").isNull(), 1).when(by_word | F.coalesce(by_alias, F.lit(False)), 3).when(F.col("carried"), 2).when(F.col("k.names").isNotNull(), 0).otherwise(1)
    names = F.array(F.lit("mismatch"), F.lit("unknown"), F.lit("syndicated"), F.lit("match"))
    return best.select("id", rank.alias("rank")).groupBy("id").agg(F.element_at(names, F.max("rank") + 1).alias("verdict"))


def clear_collisions(rows: DataFrame, partition: tuple[str, ...] = ("panel",), url: str = "url", seq: str = "id") -> DataFrame:
    """url_kept: null where an earlier row bound the link to a headline that isn't the same story. Only links that pass the screens claim."""
    u = F.col(url)
    claims = F.coalesce((links.link_safety(u) == "ok") & (links.link_shape(u) == "article"), F.lit(False))
    # Rows without a claim are no part of any window: they are many, and would be one group.
    able, rest = rows.where(claims), rows.where(~claims)
    w = Window.partitionBy(*partition, url).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    out = able.withColumns({"_first": F.first("title").over(w), "_owner": F.first(seq).over(w)})
    loses = (F.col("_owner") < F.col(seq)) & ~text.same_story(F.col("title"), F.col("_first"))
    kept = out.withColumn("url_kept", F.when(loses, None).otherwise(u)).drop("_first", "_owner")
    return kept.unionByName(rest.withColumn("url_kept", u))


def apply_verdicts(rows: DataFrame, audit: DataFrame, url: str = "url") -> DataFrame:
    """Verdicts of an audit (id, url, status) for the rows whose canonical link is still the audited one."""
    a = audit.select("id", links.canonical_url(F.col("url")).alias("_audited"), "status")
    return rows.join(a, "id").where(links.canonical_url(F.col(url)) == F.col("_audited")).drop("_audited")


def write_back(rows: DataFrame, clear_title_mismatch: bool = False, url: str = "url") -> DataFrame:
    """Proven-wrong links are cleared, attempts grow by one, verified means valid."""
    wrong = F.col("status").isin(*PROVEN_WRONG) | (F.lit(clear_title_mismatch) & (F.col("status") == "title_mismatch_high"))
    return rows.withColumns({url: F.when(wrong, None).otherwise(F.col(url)), "attempts": F.col("attempts") + 1, "verified": F.col("status") == "valid"})


def crawl_verdict(status: Column, error: Column, final_url: Column, title: Column) -> Column:
    """Verdict of one crawl: errors first, then codes, then where it ended and what it shows."""
    return (
        F.when(error == "timeout", "timeout")
        .when(error.isNotNull(), "network_error")
        .when(links.link_safety(final_url) == "unsafe", "unsafe")
        .when(status.isin(404, 410), "dead")
        .when(status.isin(401, 403), "blocked")
        .when(status == 429, "rate_limited")
        .when(~status.between(200, 299) | status.isNull(), "unknown")
        .when(title.rlike(NOT_FOUND), "soft_404")
        .when(links.link_shape(final_url) == "homepage", "homepage")
        .otherwise("valid")
    )


def best_candidate(headlines: DataFrame, results: DataFrame, least: float = 0.6) -> DataFrame:
    """Per headline (id, title, aliases) the first search result (id, rank, title, url) that names an alias and shares enough words or three keywords; homepages don't count."""
    joined = headlines.select("id", F.col("title").alias("wanted"), "aliases").join(results, "id")
    a, b = text.normalize_headline(F.col("wanted")), text.normalize_headline(F.col("title"))
    named = F.exists("aliases", lambda x: F.contains(F.lower("title"), F.lower(x)))
    shared = F.size(F.array_intersect(F.transform(text.distinctive_keywords(F.col("wanted")), F.lower), F.transform(text.distinctive_keywords(F.col("title")), F.lower)))
    good = (F.size("aliases") == 0) | named
    hit = good & ((text.token_overlap(a, b) >= least) | ((F.size("aliases") > 0) & (shared >= 3))) & (links.link_shape(F.col("url")) == "article")
    w = Window.partitionBy("id").orderBy("rank")
    return joined.where(hit).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("id", "rank", "title", "url")


def rank_candidates(headlines: DataFrame, results: DataFrame, least: float = 0.6) -> DataFrame:
    """Per headline (id, title, host) the result of at least this overlap, same publisher first, then the higher score."""
    joined = headlines.select("id", F.col("title").alias("wanted"), "host").join(results, "id")
    score = text.token_overlap(text.normalize_headline(F.col("wanted")), text.normalize_headline(F.col("title")))
    same = F.coalesce(links.hosts_related(F.col("host"), links.host_of(F.col("url"))), F.lit(False))
    w = Window.partitionBy("id").orderBy(F.desc("same"), F.desc("score"), "rank")
    return joined.withColumns({"score": score, "same": same}).where(F.col("score") >= least).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("id", "rank", "url", "score", "same")


def resolve_by_group(rows: DataFrame, resolved: DataFrame, key: Column) -> DataFrame:
    """One lookup per distinct headline form, written back to all its rows. resolved: (key, url)."""
    return rows.withColumn("_key", key).join(resolved.select(F.col("key").alias("_key"), F.col("url").alias("resolved_url")), "_key", "left").drop("_key")


def redate(rows: DataFrame, far_days: int = 400) -> DataFrame:
    """status of rows with a stored date and a found one: not_found, same, too_far or corrected; and the date to keep."""
    apart = F.abs(F.datediff("found", "date"))
    status = F.when(F.col("found").isNull(), "not_found").when(apart == 0, "same").when(apart > far_days, "too_far").otherwise("corrected")
    return rows.withColumn("status", status).withColumn("new_date", F.when(F.col("status") == "corrected", F.col("found")).otherwise(F.col("date")))


def _common(a: Column, b: Column) -> Column:
    """How many elements two sorted arrays share, repeats counted: one walk along both."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n"))

    def step(p: Column, acc: Column) -> Column:
        def moved(x: Column) -> Column:
            at = lambda i, j, n: F.struct((acc["i"] + i).alias("i"), (acc["j"] + j).alias("j"), (acc["n"] + n).alias("n"))
            return F.when(x["a"] == x["b"], at(1, 1, 1)).when(x["a"] < x["b"], at(1, 0, 0)).when(x["a"] > x["b"], at(0, 1, 0)).otherwise(acc)

        return text.let(F.struct(F.get(p["a"], acc["i"]).alias("a"), F.get(p["b"], acc["j"]).alias("b")), moved)

    walked = lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p["a"]) + F.size(p["b"])), start, lambda acc, _: step(p, acc))["n"]
    return F.when((F.size(a) > 0) & (F.size(b) > 0), text.let(F.struct(a.alias("a"), b.alias("b")), walked)).otherwise(0)


def dice(left: Column, right: Column) -> Column:
    """Multiset Dice similarity of the character pairs of the compared forms; equal texts 1, texts under two characters 0. Nothing leaves the row."""
    # A pair as one number: whole arrays of strings would hold a hundred bytes per pair.
    codes = lambda c: text.let(F.transform(F.split(c, ""), lambda x: F.ascii(x)), lambda u: F.array_sort(F.transform(F.sequence(F.lit(1), F.size(u) - 1), lambda k: F.get(u, k - 1) * 65_536 + F.get(u, k))))
    pairs = lambda c: F.when(F.length(c) >= 2, codes(c)).otherwise(F.array().cast("array<int>"))

    def compared(x: Column) -> Column:
        a, b = x["a"], x["b"]
        short = (F.length(a) < 2) | (F.length(b) < 2)
        return F.when((a == b) & (a != ""), 1.0).when(short, 0.0).otherwise(2.0 * _common(pairs(a), pairs(b)) / (F.length(a) + F.length(b) - 2))

    return text.let(F.struct(classify.compare_form(left).alias("a"), classify.compare_form(right).alias("b")), compared)


def dice_bigram(pairs: DataFrame, left: str = "a", right: str = "b", key: str = "id") -> DataFrame:
    """(key, dice) of each pair."""
    return pairs.select(key, dice(F.col(left), F.col(right)).alias("dice"))


def redate_counts(redated: DataFrame) -> DataFrame:
    """How many rows of redate() have which status."""
    return redated.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def crawl_audit(rows: DataFrame, aliases: DataFrame, syndication: DataFrame) -> DataFrame:
    """(id, verdict) of a crawl log (id, status, error, final_url, page_title, headline, source_label): crawl_verdict, and of the pages that it
    finds valid, mismatch where the label names another publisher than the host's, else what the page's title says:
    title_mismatch_high, title_mismatch_medium, title_unknown, or valid where it matches. Ids are unique.
    """
    from tallyroom.operators.audits import title_verdicts

    first = rows.withColumn("_first", crawl_verdict(F.col("status"), F.col("error"), F.col("final_url"), F.col("page_title")))
    open_ = first.where("_first = 'valid'")
    labels = label_host_verdict(open_.select("id", "source_label", "final_url"), aliases, syndication, url="final_url").withColumnRenamed("verdict", "_label")
    titles = title_verdicts(open_.select("id", "headline", "page_title", links.host_of(F.col("final_url")).alias("host"))).select("id", F.col("verdict").alias("_title"))
    judged = first.join(labels, "id", "left").join(titles, "id", "left")
    later = F.when(F.col("_label") == "mismatch", "mismatch").when(F.col("_title") != "match", F.col("_title")).otherwise("valid")
    return judged.select("id", F.when(F.col("_first") == "valid", later).otherwise(F.col("_first")).alias("verdict"))
