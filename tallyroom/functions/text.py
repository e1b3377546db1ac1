"""Headline columns: normal forms, hashes, shingles, numbers, overlaps. All are built from Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers of record blocks, and the words that two stop lists leave out.
FIELD_MARKERS = ["DATE", "SOURCE", "SUMMARY", "CATEGORY", "IMPACT_LEVEL", "HEADLINE", "URL"]
STORY_STOP = ["the", "and", "for", "with", "that", "this", "from", "ที่", "และ", "ของ", "ใน", "เป็น", "ให้", "จาก", "กับ", "ไทย", "ข่าว", "หุ้น", "บริษัท"]
KEYWORD_STOP = ["the", "and", "for", "with", "that", "this", "from", "2569", "2568", "2567", "69", "68", "67", "66"]

#: What a publisher after a spaced dash is, and which signs each normal form drops.
SUFFIX = r"\s+-\s+[^-\x{0E00}-\x{0E7F}]+$"
PUNCTUATION = r"[()\[\]{}\"'`.,!?;:]"
DEDUP_PUNCTUATION = r"[()\[\]{}\"'`.,!?;:*–—\-_/\\|]"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_headline(c: Column) -> Column:
    """Without a trailing publisher after a spaced dash and without punctuation; lower case, single spaces."""
    out = F.regexp_replace(F.lower(F.regexp_replace(_text(c), SUFFIX, "")), PUNCTUATION, "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def title_hash(title: Column, *fallback: Column) -> Column:
    """SHA-1 of the normal form; where that is empty, of the fallback columns."""
    return F.sha1(F.coalesce(F.nullif(normalize_headline(title), F.lit("")), F.concat(*map(_text, (title, *fallback)))))


def normalize_for_dedup(c: Column) -> Column:
    """Without field markers, publisher, punctuation and all white space."""
    out = F.regexp_replace(_text(c), rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(FIELD_MARKERS)})\s*:\s*", " ")
    out = F.lower(F.regexp_replace(out, SUFFIX, ""))
    return F.regexp_replace(F.regexp_replace(out, DEDUP_PUNCTUATION, " "), r"\s+", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(c: Column, n: int) -> Column:
    """All character n-grams in order, [] for shorter texts: one pass over the text, which looks n characters ahead of each, so that the time is linear in its length."""
    return F.regexp_extract_all(_text(c), F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def shingles(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams."""
    return F.array_distinct(ngrams(c, n))


def numeric_anchors(c: Column) -> Column:
    """Distinct numbers, without their commas."""
    found = F.regexp_extract_all(_text(c), F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(""))))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either array is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Common elements over the smaller array; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(0.0)


def truncate_headline(c: Column, limit: int = 100, least: int = 60) -> Column:
    """Headlines over limit are cut at the last space up to it, if that is at least at the given place, and end in an ellipsis."""
    head = F.regexp_extract(F.substring(c, 1, limit + 1), r"(?s)^(.*) ", 1)
    cut = F.when(F.length(head) >= least, head).otherwise(F.substring(c, 1, limit))
    return F.when(F.length(_text(c)) <= limit, _text(c)).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def clean_markup(c: Column) -> Column:
    """Without CDATA marks and tags, five entities decoded."""
    out = F.regexp_replace(F.regexp_replace(_text(c), r"<!\[CDATA\[|\]\]>", ""), r"<[^>]+>", "")
    for entity, sign in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(out)


def token_overlap(a: Column, b: Column, least: int = 4) -> Column:
    """Share of a's tokens of least characters or more that b contains; 0 without such tokens. Both are normal forms."""
    tokens = F.filter(F.split(a, " "), lambda t: F.length(t) >= least)

    def counted(x: Column) -> Column:
        # Whole tokens of b are found by hash; b is searched for the others alone, once each.
        missing = F.filter(F.array_except(x["tokens"], F.split(x["b"], " ")), lambda t: ~F.contains(x["b"], t))
        return let(missing, lambda m: (F.size(x["tokens"]) - F.size(F.filter(x["tokens"], lambda t: F.array_contains(m, t)))) / F.size(x["tokens"]))

    shared = let(F.struct(tokens.alias("tokens"), F.coalesce(b, F.lit("")).alias("b")), counted)
    return F.when(F.size(tokens) > 0, shared).otherwise(0.0)


def story_tokens(c: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(_text(c)), PUNCTUATION, " "), r"\s+")
    return F.filter(words, lambda t: (F.length(t) >= 3) & ~t.isin(STORY_STOP))


def same_story(a: Column, b: Column) -> Column:
    """Two tokens at least in common, and three fifths of the shorter headline's; repeats in a count."""


    def compared(p: Column) -> Column:
        x, y = p["x"], p["y"]
        common = F.array_intersect(x, y)  # hashed; only where tokens repeat is each one of x looked up
        shared = F.when(F.size(F.array_distinct(x)) == F.size(x), F.size(common)).otherwise(F.size(F.filter(x, lambda t: F.array_contains(common, t))))
        enough = shared / F.least(F.size(x), F.size(y)) >= 0.6
        return F.when((F.size(x) > 0) & (F.size(y) > 0), enough & (shared >= 2)).otherwise(False)

    return let(F.struct(story_tokens(a).alias("x"), story_tokens(b).alias("y")), compared)


def distinctive_keywords(c: Column) -> Column:
    """Latin words and numbers, two characters at least, without the stop list."""
    found = F.regexp_extract_all(_text(c), F.lit(r"(?i)([a-z][a-z0-9]*|[0-9]+(?:[.,][0-9]+)*\s*[%$]?)"), F.lit(1))
    bare = lambda t: F.lower(F.regexp_replace(t, r"[.,%$]", ""))
    return F.filter(found, lambda t: (F.length(bare(t)) >= 2) & ~bare(t).isin(KEYWORD_STOP))
