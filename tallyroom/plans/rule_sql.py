"""The rule tables as DuckDB expressions. Its patterns know no look-around: edges are spelt out, between doubled separators."""

from __future__ import annotations

import re

from tallyroom.functions import classify, publishers, rules
from tallyroom.operators import audits, linkjobs


def pattern(p: str) -> str:
    """A Java pattern for a test: look-arounds of one character class become that class or the text's end."""
    p = re.sub(r"\(\?<!(\[)([^\]]*\])\)", r"(?:^|[^\2)", p)
    p = re.sub(r"\(\?!(\[)([^\]]*\])\)", r"(?:$|[^\2)", p)
    return "'" + p.replace("'", "''") + "'"


def test(text: str, p: str) -> str:
    return f"regexp_matches({text}, {pattern(p)})"


def first_match(text: str, table: list[tuple[str, str]], otherwise: str | None = None) -> str:
    """The label of the first rule whose pattern the text has."""
    cases = " ".join(f"WHEN {test(text, p)} THEN '{label}'" for p, label in table)
    return f"CASE {cases} ELSE {'NULL' if otherwise is None else repr(otherwise)} END"


def has_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def mentions_title(text: str) -> str:
    scrubbed = f"regexp_replace({text}, {pattern(classify.TITLE_DEED)}, ' ', 'g')"
    brand = test(scrubbed, r"(?<![A-Za-z])The Title\s+[A-Z\x{0E00}-\x{0E7F}]")
    ticker = test(scrubbed, "(?<![A-Za-z])TITLE(?![A-Za-z])") + " AND " + test(scrubbed, classify.TITLE_CUE)
    return f"({has_any(text, classify.TITLE_NAMES)} OR {test(text, '(?i)rhom' + chr(92) + 's*bho')} OR {brand} OR ({ticker}))"


def strip_site_suffix(text: str) -> str:
    t = f"regexp_replace(regexp_replace(trim({text}, ' '), '[\\s|｜\\-–—:]+$', ''), '^[\\s|｜\\-–—:]+', '')"
    head = f"trim(regexp_extract({t}, '^(.*?)(?:\\s+[\\-–—]\\s+|\\s*[|｜]\\s*)([^|｜]{{2,40}})$', 1), ' ')"
    return f"CASE WHEN length({head}) >= 8 THEN {head} ELSE {t} END"


def generic_title(text: str, word: str) -> str:
    """A page title that names no story, on a host with this first word."""
    names = ", ".join("'" + x.replace("'", "''") + "'" for x in sorted({*audits.GENERIC, *(a.lower() for names in publishers.NAMES.values() for a in names)}))
    low, bare = f"lower(trim({text}, ' '))", f"lower({strip_site_suffix(text)})"
    own = f"regexp_replace({low}, '[^a-z0-9]', '', 'g') = '{word}'"
    return f"({low} = '' OR {bare} = '' OR {low} IN ({names}) OR {bare} IN ({names}) OR {own} OR (length({low}) <= 4 AND NOT regexp_matches({low}, '[\\x{{0E00}}-\\x{{0E7F}}]')))"


def not_found(text: str) -> str:
    return test(text, linkjobs.NOT_FOUND)


def category(text: str, panel: str) -> str:
    """Without a hint, for panel TITLE or another."""
    title = mentions_title(text)
    if panel == "TITLE":
        industry = f"CASE WHEN {test(text, classify.TITLE_INDUSTRY)} THEN 'INDUSTRY' END"
        return f"CASE WHEN {text} = '' THEN 'MACRO' ELSE coalesce(CASE WHEN {title} THEN 'COMPANY' END, {first_match(text, classify.TITLE_RULES)}, {industry}, 'MACRO') END"
    company = has_any(f"lower({text})", classify.COMPANY_NAMES)
    tickers = "(?<![A-Za-z])(" + "|".join(classify.COMPETITOR_TICKERS) + ")(?![A-Za-z])"
    competitor = f"{has_any(f'lower({text})', classify.COMPETITOR_NAMES)} OR {test(text, tickers)}"
    industry = f"CASE WHEN {test(text, classify.ASW_INDUSTRY)} THEN 'INDUSTRY' END"
    return f"CASE WHEN {text} = '' THEN 'MACRO' ELSE coalesce(CASE WHEN {company} OR {title} THEN 'COMPANY' END, {first_match(text, classify.ASW_RULES)}, CASE WHEN {competitor} THEN 'COMPETITOR' END, {industry}, 'MACRO') END"


def remark_bucket(text: str) -> str:
    return f"CASE WHEN trim({text}) <> '' THEN {first_match(f'trim({text})', rules.REMARK_RULES, 'other')} END"


def event_type(text: str) -> str:
    return first_match(text, rules.EVENT_RULES)


def _all(text: str, p: str, value: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{p}', 1), lambda x: {value})"


def event_parameters(text: str) -> str:
    doubled = f"regexp_replace({text}, '([^A-Za-z0-9_])', '\\1\\1', 'g')"
    edge, end = "(?:^|[^A-Za-z0-9_])", "(?:$|[^A-Za-z0-9_])"
    era = "'y' || (CAST(x AS INTEGER) + 2500)"
    parts = [
        _all(text, r"([0-9]+(?:\.[0-9]+)?)\s*%", "'p' || x"),
        _all(text, r"([0-9]+(?:[.,][0-9]+)?)\s*ล้าน", "'m' || replace(x, ',', '')"),
        _all(doubled, f"{edge}(25[0-9]{{2}}){end}", "'y' || x"),
        _all(text, rf"ปี\s*([0-9]{{2}}){end}", era),
        _all(text, rf"[ก-ฮ]{{1,2}}\.\s?[ก-ฮ]\.\s*([0-9]{{2}}){end}", era),
    ]
    return "list_sort(list_distinct(" + " || ".join(parts) + "))"


def fingerprint(text: str) -> str:
    revised = f"CASE WHEN {test(text, classify.REVISIONS)} THEN 'REVISED' ELSE 'SAME' END"
    parts = f"{first_match(text, classify.ACTORS, 'UNSPEC')} || '|' || {first_match(text, classify.STAGES, 'ANNOUNCE')} || '|' || {revised} || '|' || array_to_string({event_parameters(text)}, ',')"
    return f"{first_match(text, classify.MEASURES)} || '|' || {parts}"


def host(u: str) -> str:
    return f"regexp_replace(lower(regexp_extract({u}, '^[a-zA-Z]+://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '^www\\.', '')"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"


def query(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"


def link_shape(u: str) -> str:
    p, last = path(u), f"regexp_extract({path(u)}, '/([A-Za-z0-9_-]{{6,}})$', 1)"
    listing = test(p, "(?i)^/(home|index(\\.[a-z]+)?|(category|categories|tag|tags|topic|topics|search|section|author)(/.*)?)/?$")
    article = f"{test(query(u), '(?i)(^|&)[a-z_]*id=[0-9]+')} OR {test(p, '/[0-9]{4}/[0-9]{2}/')} OR {test(p, '[0-9]{5,}')} OR {test(p, '[^/-]+-[^/-]+-[^/-]+')}"
    opaque = f"{test(last, '[0-9]')} AND {test(last, '[A-Z]')}"
    return f"CASE WHEN {listing} THEN 'homepage' WHEN {article} THEN 'article' WHEN {p} IN ('', '/') THEN 'homepage' WHEN {opaque} THEN 'article' WHEN {test(p, '^/[^/]+/?$')} THEN 'homepage' ELSE 'article' END"


def link_safety(u: str) -> str:
    """For hosts that are names or dotted numbers."""
    h = host(u)
    private = "^(0|10|127)\\.|^(22[4-9]|2[3-5][0-9])\\.|^169\\.254\\.|^172\\.(1[6-9]|2[0-9]|3[01])\\.|^192\\.168\\.|^100\\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\\."
    numeric = test(h, "^[0-9]{1,3}(\\.[0-9]{1,3}){3}$")
    named = test(h, "^(localhost|.*\\.(local|internal|localhost)|metadata(\\..*)?)$")
    return f"CASE WHEN NOT {test(u, '(?i)^https?://')} OR {h} = '' OR {test(u, '^[a-zA-Z]+://[^/?#]*@')} OR ({numeric} AND {test(h, private)}) OR {named} THEN 'unsafe' ELSE 'ok' END"


def canonical_url(u: str) -> str:
    """For links without a port."""
    plain = f"lower(regexp_extract({u}, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract({u}, '^[a-zA-Z]+://(?:[^/?#@]*@)?([^/:?#]+)', 1))"
    single = f"regexp_replace({path(u)}, '/{{2,}}', '/', 'g')"
    trimmed = f"CASE WHEN {single} IN ('', '/') THEN '/' ELSE regexp_replace({single}, '/$', '') END"
    params = f"list_sort(list_filter(string_split({query(u)}, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^(utm_[a-z_]+|fbclid|gclid|mc_cid|mc_eid|igshid)$')))"
    return f"{plain} || {trimmed} || CASE WHEN len({params}) > 0 THEN '?' || array_to_string({params}, '&') ELSE '' END"


def story_tokens(t: str, stop: list[str]) -> str:
    words = ", ".join(f"'{w}'" for w in stop)
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({t}), '[()\\[\\]{{}}\"''`.,!?;:]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3 AND w NOT IN ({words}))"


def same_story(a: str, b: str, stop: list[str]) -> str:
    x, y = story_tokens(a, stop), story_tokens(b, stop)
    shared = f"len(list_filter({x}, lambda w: list_contains({y}, w)))"
    return f"(len({x}) > 0 AND len({y}) > 0 AND {shared} >= 2 AND {shared}::DOUBLE / greatest(least(len({x}), len({y})), 1) >= 0.6)"
