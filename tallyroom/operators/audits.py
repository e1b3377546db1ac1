"""Title audits, link vetting, grounding checks and cross-batch link claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.functions import classify, links, publishers, text
from tallyroom.operators.dedup import _spread
from tallyroom.operators.linkjobs import clear_collisions, dice, label_host_verdict

#: Page titles that name no story, and what score and overlap make a match.
GENERIC = ["msn", "msn.com", "home", "homepage", "หน้าแรก", "news", "ข่าว", "untitled", "document", "loading", "กำลังโหลด", "redirecting"]
MATCH, MATCH_WITH_EVIDENCE, MISMATCH = 0.55, 0.30, 0.15
#: Entities that tie a headline to a page.
ENTITIES = [
    r"ครม\.?|คณะรัฐมนตรี",
    r"กนง\.?|คณะกรรมการนโยบายการเงิน",
    r"ธปท\.?|ธนาคารแห่งประเทศไทย|แบงก์ชาติ",
    r"ก\.ล\.ต\.?|สำนักงานคณะกรรมการกำกับหลักทรัพย์",
    r"ธอส\.?|ธนาคารอาคารสงเคราะห์",
    "กรมที่ดิน",
    "ราชกิจจา",
    r"สศช\.?|สภาพัฒน์|สำนักงานสภาพัฒนาการเศรษฐกิจ",
    r"กกร\.?|คณะกรรมการร่วมภาคเอกชน",
    r"(?i)ใบสำคัญแสดงสิทธิ|วอร์แรนต์|warrant|-W[0-9](?![A-Za-z0-9_])",
    "(?i)REIC|ศูนย์ข้อมูลอสังหาริมทรัพย์",
    "BOI",
    "Fed|เฟด",
    "BOJ",
    "ECB",
    "(?i)(?<![A-Za-z0-9_])ASW(?![A-Za-z0-9_])|AssetWise|แอสเซทไวส์",
    "(?i)(?<![A-Za-z0-9_])SPALI(?![A-Za-z0-9_])|ศุภาลัย",
    "(?<![A-Za-z0-9_])AP(?![A-Za-z0-9_])|เอพี",
    "(?<![A-Za-z0-9_])LH(?![A-Za-z0-9_])|แลนด์แอนด์เฮ้าส์",
    "(?i)(?<![A-Za-z0-9_])SIRI(?![A-Za-z0-9_])|แสนสิริ",
    "(?i)(?<![A-Za-z0-9_])ORI(?![A-Za-z0-9_])|ออริจิ้น",
    "(?i)(?<![A-Za-z0-9_])NOBLE(?![A-Za-z0-9_])|โนเบิล",
    "(?i)(?<![A-Za-z0-9_])ANAN(?![A-Za-z0-9_])|อนันดา",
    "(?i)(?<![A-Za-z0-9_])QH(?![A-Za-z0-9_])|ควอลิตี้",
    "(?<![A-Za-z0-9_])SC(?![A-Za-z0-9_])",
    "(?i)(?<![A-Za-z0-9_])TRIS(?![A-Za-z0-9_])|ทริส",
    "(?i)(?<![A-Za-z0-9_])LTV(?![A-Za-z0-9_])",
    "(?i)(?<![A-Za-z0-9_])GDP(?![A-Za-z0-9_])",
    "(?i)(?<![A-Za-z0-9_])CPI(?![A-Za-z0-9_])",
    "(?<![A-Za-z0-9_])SET(?![A-Za-z0-9_])",
]


def entities_in(c: Column) -> Column:
    """Numbers of the entity patterns that a text has."""
    return F.filter(F.array(*(F.when(c.rlike(p), F.lit(i)) for i, p in enumerate(ENTITIES))), lambda x: x.isNotNull())


def is_generic_title(c: Column, host: Column) -> Column:
    """No title, a site's or publisher's own name, a placeholder, nothing but a suffix, or up to four characters without Thai."""
    low, bare = F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lower(classify.strip_site_suffix(c))
    word = F.element_at(F.split(F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"^www\.", ""), r"\."), 1)
    letters = lambda x: F.regexp_replace(x, "[^a-z0-9]", "")
    own = (word != "") & (letters(low) == letters(word))
    named = publishers.is_publisher_name(low) | publishers.is_publisher_name(bare)
    return (low == "") | (bare == "") | low.isin(GENERIC) | bare.isin(GENERIC) | named | own | ((F.length(low) <= 4) & ~low.rlike(r"[\x{0E00}-\x{0E7F}]"))


def longest_run(a: Column, b: Column) -> Column:
    """Length of the longest run of characters that both texts have.

    Runs of 2^k characters are known by hashes of their halves, for every place of a text; a length is then built bit by bit from the
    largest down, kept whenever some run of that length is in both. Time grows as length times its logarithm, for repetitive texts
    too, and nothing leaves the row. Hashes have 64 bits.
    """
    places = lambda h, last, f: F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), f)).otherwise(F.array().cast("array<long>"))

    def doubled(h: Column, k: Column) -> Column:
        half = F.call_function("shiftleft", F.lit(1), k - 1)
        return places(h, F.size(h) - 1 - half, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + half)))

    def levels(top: Column) -> Column:
        """Of both texts, up to the first level without a common run: longer runs have none either."""
        first = lambda c: F.array(F.transform(F.split(c, ""), lambda x: F.xxhash64(x))).cast("array<array<long>>")
        more = lambda acc, k: F.struct(*(F.concat(acc[s], F.array(doubled(F.element_at(acc[s], -1), k))).alias(s) for s in "ab"))
        shared = lambda acc: F.arrays_overlap(F.element_at(acc["a"], -1), F.element_at(acc["b"], -1))
        both = F.struct(first(a).alias("a"), first(b).alias("b"))
        return F.when(top > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), both, lambda acc, k: F.when(shared(acc), more(acc, k)).otherwise(acc))).otherwise(both)

    def longer(h: Column, now: Column, n: Column, k: Column) -> Column:
        """Hashes of the runs of n + 2^k characters, from those of n and of 2^k."""
        return places(now, F.size(h) - 1 - n, lambda i: F.xxhash64(F.get(now, i), F.get(h, i + n)))

    def step(acc: Column, k: Column, x: Column) -> Column:
        tried = F.struct(longer(F.get(x["a"], k), acc["a"], acc["n"], k).alias("a"), longer(F.get(x["b"], k), acc["b"], acc["n"], k).alias("b"), (acc["n"] + F.call_function("shiftleft", F.lit(1), k)).alias("n"))
        return text.let(tried, lambda t: F.when(F.arrays_overlap(t["a"], t["b"]), t).otherwise(acc))

    empty = lambda c: F.array_repeat(F.lit(0).cast("long"), F.length(c) + 1)
    top = F.floor(F.log2(F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)).cast("double"))).cast("int")
    start = F.struct(empty(a).alias("a"), empty(b).alias("b"), F.lit(0).alias("n")).cast("struct<a: array<long>, b: array<long>, n: int>")
    run = text.let(top, lambda t: text.let(levels(t), lambda x: F.aggregate(F.reverse(F.sequence(F.lit(0), F.size(x["a"]) - 1)), start, lambda acc, k: step(acc, k, x))["n"]))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), run).otherwise(0)


def lcs_ratio(left: Column, right: Column) -> Column:
    """Longest common run of characters of the compared forms over the shorter one; 1 if one holds the other, 0 if either is empty. Whole texts."""

    def compared(x: Column) -> Column:
        shorter = F.when(F.length(x["a"]) <= F.length(x["b"]), x["a"]).otherwise(x["b"])
        held = F.contains(x["a"], x["b"]) | F.contains(x["b"], x["a"])
        return F.when(F.length(shorter) == 0, 0.0).when(held, 1.0).otherwise(longest_run(x["a"], x["b"]) / F.length(shorter))

    return text.let(F.struct(classify.compare_form(left).alias("a"), classify.compare_form(right).alias("b")), compared)


def lcs_containment(pairs: DataFrame, left: str = "a", right: str = "b", key: str = "id") -> DataFrame:
    """(key, containment): lcs_ratio of each pair."""
    return pairs.select(key, lcs_ratio(F.col(left), F.col(right)).alias("containment"))


def title_verdicts(rows: DataFrame) -> DataFrame:
    """(id, verdict, score) of headlines against page titles. rows: id, headline, page_title, host."""
    # Dealt out: a few bytes of titles take long, so that they must not be put together after a join.
    clean = _spread(rows, "id").select("id", F.col("headline").alias("a"), classify.strip_site_suffix(F.col("page_title")).alias("b"), (is_generic_title(F.col("page_title"), F.col("host")) | (F.trim(F.coalesce("headline", F.lit(""))) == "")).alias("generic"))
    # A generic title has no score; where Dice is 1 no run can add to it.
    best = text.let(dice(F.col("a"), F.col("b")), lambda d: F.when(d >= 1, d).otherwise(F.greatest(d, lcs_ratio(F.col("a"), F.col("b")))))
    scored = clean.withColumn("score", F.when(~F.col("generic"), best))
    shared = (F.size(F.array_intersect(entities_in(F.col("a")), entities_in(F.col("b")))) > 0) | (F.size(F.array_intersect(classify.numbers_in(F.col("a")), classify.numbers_in(F.col("b")))) > 0)
    verdict = F.when(F.col("generic"), "title_unknown").when(F.col("score") >= MATCH, "match").when((F.col("score") >= MATCH_WITH_EVIDENCE) & shared, "match").when((F.col("score") < MISMATCH) & ~shared, "title_mismatch_high").otherwise("title_mismatch_medium")
    return scored.select("id", verdict.alias("verdict"), F.when(F.col("generic"), 0.0).otherwise(F.round("score", 3)).alias("score"))


def link_vet(rows: DataFrame, aliases: DataFrame, syndication: DataFrame, partition: tuple[str, ...] = ("panel",)) -> DataFrame:
    """rows (id, panel, title, url, source_label) with url_kept and reason: unsafe, homepage, mismatch, collision or ok. Rows are never dropped."""
    safe, shape = links.link_safety(F.col("url")), links.link_shape(F.col("url"))
    out = rows.join(label_host_verdict(rows, aliases, syndication), "id", "left")
    screen = F.when(F.col("url").isNull() | (F.col("url") == ""), "no_link").when(safe == "unsafe", "unsafe").when(shape == "homepage", "homepage").when(F.col("verdict") == "mismatch", "mismatch")
    out = out.withColumn("screen", screen).withColumn("_claim", F.when(F.col("screen").isNull(), F.col("url")))
    vetted = clear_collisions(out, partition, "_claim")
    reason = F.coalesce("screen", F.when(F.col("url_kept").isNull(), "collision"), F.lit("ok"))
    return vetted.withColumn("reason", reason).drop("screen", "_claim", "verdict")


def vet_report(vetted: DataFrame) -> DataFrame:
    return vetted.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count("url_kept").alias("kept"))


def grounded_links(items: DataFrame) -> DataFrame:
    """url_kept of items (id, url, cited_hosts): safe articles whose host relates to a cited one."""
    u = F.col("url")
    cited = F.exists("cited_hosts", lambda h: links.hosts_related(links.host_of(u), F.lower(h)))
    good = (links.link_safety(u) == "ok") & (links.link_shape(u) == "article") & F.coalesce(cited, F.lit(False))
    return items.withColumn("url_kept", F.when(good, u))


def best_chunk(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per item (id, source) its chunk (id, position, title, uri) whose title contains the source's name or is contained in it; else the first."""
    a, b = F.lower(F.coalesce("source", F.lit(""))), F.lower("title")
    hit = (a != "") & (F.contains(a, b) | F.contains(b, a))
    w = Window.partitionBy("id").orderBy(F.desc("hit"), "position")
    return items.select("id", "source").join(chunks, "id").withColumn("hit", hit).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("id", "position", "uri")


def claim_urls(batch: DataFrame, claims: DataFrame, today, keep_days: int = 30) -> tuple[DataFrame, DataFrame]:
    """The batch with url_kept, and the claims after it: per panel the first headline to claim a link keeps it until it expires.

    claims: panel, url, title, claimed_on. Claims older than keep_days are dropped.
    """
    day = F.lit(today).cast("date")
    live = claims.where(F.col("claimed_on") >= F.date_sub(day, keep_days))
    old = live.select("panel", "url", "title", F.lit(-1).cast("long").alias("id"))
    both = clear_collisions(old.unionByName(batch.select("panel", "url", "title", F.col("id").cast("long").alias("id"))))
    out = both.where("id >= 0")
    fresh = out.where("url_kept is not null").groupBy("panel", "url").agg(F.min_by("title", "id").alias("title")).withColumn("claimed_on", day)
    return out, live.unionByName(fresh.join(live.select("panel", "url"), ["panel", "url"], "left_anti"))


def claims_in_order(rows: DataFrame, owners: DataFrame | None = None, keep_days: int = 30) -> tuple[DataFrame, DataFrame]:
    """rows (id, panel, url, title, date) with url_kept, and the owners after them (panel, url, id, title, claimed_on).

    Per panel the first headline by (date, id) claims a link and keeps it for keep_days after that day; the first one later claims it anew. A row keeps
    its link if it owns it or tells its owner's story. Rows dated before the known owner's day are held against that owner. Rows whose
    link can't be claimed, or without a date, keep it as it is.

    What is folded per link is one entry per day, however many rows share the link: owners are looked up by (panel, link, day).
    """
    u = F.col("url")
    claims = F.coalesce((links.link_safety(u) == "ok") & (links.link_shape(u) == "article") & F.col("date").isNotNull(), F.lit(False))
    if owners is None:
        owners = rows.select("panel", "url", "id", "title", F.col("date").alias("claimed_on")).where(F.lit(False))
    known = owners.groupBy("panel", "url").agg(F.max(F.struct(F.col("claimed_on").alias("date"), "id", "title")).alias("_known"))
    able = rows.where(claims).join(known, ["panel", "url"], "left").withColumn("_day", F.greatest("date", "_known.date"))
    entry = F.struct(F.lit(1).alias("fresh"), "id", "title")
    days = able.groupBy("panel", "url", F.col("_day").alias("date")).agg(F.min(entry).alias("x"), F.first("_known").alias("_known"))
    entries = F.sort_array(F.collect_list(F.struct("date", "x.fresh", "x.id", "x.title")))
    per_link = days.groupBy("panel", "url").agg(entries.alias("days"), F.first("_known").alias("_known"))
    start = F.expr("if(_known is null, array(), array(named_struct('date', _known.date, 'fresh', 0, 'id', _known.id, 'title', _known.title)))").cast(per_link.schema["days"].dataType)
    late = lambda acc, x: (F.size(acc) == 0) | (x["date"] > F.date_add(F.element_at(acc, -1)["date"], keep_days))
    folded = per_link.select("panel", "url", "days", F.aggregate("days", start, lambda acc, x: F.when(late(acc, x), F.concat(acc, F.array(x))).otherwise(acc)).alias("owners"))
    owner = F.transform("days", lambda x: F.struct(x["date"].alias("_day"), F.element_at(F.filter("owners", lambda o: o["date"] <= x["date"]), -1).alias("_owner")))
    held = folded.select("panel", "url", F.explode(owner).alias("x")).select("panel", "url", "x.*")
    out = able.join(held, ["panel", "url", "_day"])
    keeps = (F.col("id") == F.col("_owner.id")) | text.same_story(F.col("title"), F.col("_owner.title"))
    columns = [*rows.columns, "url_kept"]
    kept = out.withColumn("url_kept", F.when(keeps, u)).select(*columns).unionByName(rows.where(~claims).withColumn("url_kept", u).select(*columns))
    after = folded.select("panel", "url", F.explode("owners").alias("o")).where("o.fresh = 1").select("panel", "url", "o.id", "o.title", F.col("o.date").alias("claimed_on"))
    return kept, after
