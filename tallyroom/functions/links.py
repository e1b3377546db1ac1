"""Link columns: cleaning, canonical form, hosts, and screens by shape and safety."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyroom.functions.text import let

#: Parameters that only track, and listing paths.
TRACKING = r"^(utm_[a-z_]+|fbclid|gclid|mc_cid|mc_eid|igshid)$"
LISTING = r"(?i)^/(home|index(\.[a-z]+)?|(category|categories|tag|tags|topic|topics|search|section|author)(/.*)?)/?$"
#: An article's number in a query; dated paths, long numbers and slugs; an opaque id; a path of one part.
ID_QUERY = r"(?i)(^|&)[a-z_]*id=[0-9]+"
ARTICLE_PATHS = ["/[0-9]{4}/[0-9]{2}/", "[0-9]{5,}", "[^/-]+-[^/-]+-[^/-]+"]
OPAQUE_ID = "/(?=[A-Za-z0-9_-]*[0-9])(?=[A-Za-z0-9_-]*[A-Z])[A-Za-z0-9_-]{6,}$"
ONE_PART = "^/[^/]+/?$"
#: Fixed value: redirectors.
REDIRECT = "vertexaisearch|grounding-api-redirect"


def host_of(c: Column) -> Column:
    """Lower-case host without www.; null if the link doesn't parse."""
    return F.regexp_replace(F.lower(F.try_parse_url(c, F.lit("HOST"))), r"^www\.", "")


def hosts_related(a: Column, b: Column) -> Column:
    """Equal, or one a sub-domain of the other."""
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a))


def is_usable_link(c: Column) -> Column:
    """http or https, no grounding redirect, and something after the host."""
    return F.coalesce(c.rlike("^https?://") & ~c.rlike(REDIRECT) & ~c.rlike("^https?://[^/]+/?$"), F.lit(False))


def is_malformed_link(c: Column) -> Column:
    """White space inside, or a list separator before a second scheme."""
    return F.coalesce(c.rlike(r"\s") | c.rlike(r"[,;]\s*https?://"), F.lit(False))


def is_blob_title(c: Column) -> Column:
    """Another field's marker in a title."""
    return F.coalesce(c.rlike(r"(SUMMARY|IMPACT_LEVEL|SOURCE|URL|CATEGORY|EVENT_DATE|PUBLISH_DATE|CONFIDENCE)\s*:"), F.lit(False))


def sanitize_url(c: Column) -> Column:
    """The first token without trailing separators and unopened brackets; '' if it is no web link, NONE, or a redirect."""
    s = F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(\S*)", 1), r"[,;.]+$", "")
    # Each step is bound, so that none is computed again wherever the next one uses it.
    closed = lambda opening, closing: lambda x: F.when(~F.contains(x, F.lit(opening)), F.regexp_replace(x, closing, "")).otherwise(x)
    for pair in (("(", r"\)+$"), ("[", r"\]+$"), ("{", r"\}+$")):
        s = let(s, closed(*pair))
    good = lambda x: x.rlike("(?i)^https?://") & ~x.rlike(f"(?i){REDIRECT}") & (F.upper(x) != "NONE") & F.try_parse_url(x, F.lit("HOST")).isNotNull()
    return let(s, lambda x: F.when(F.coalesce(good(x), F.lit(False)), x).otherwise(""))


def stored_url(c: Column) -> Column:
    """What a feed stores of a raw link: cleaned, and then in its canonical form, so that duplicate checks compare like with like; '' as sanitize_url."""
    return let(sanitize_url(c), lambda x: F.when(x == "", x).otherwise(canonical_url(x)))


def canonical_url(c: Column) -> Column:
    """Lower-case scheme and host, no fragment, default port, repeated or trailing slash and tracking parameters; parameters sorted. Others as they are."""
    part = lambda k: F.try_parse_url(c, F.lit(k))
    scheme, host = F.lower(part("PROTOCOL")), F.lower(part("HOST"))
    port = F.regexp_extract(part("AUTHORITY"), r":([0-9]+)$", 1)
    port = F.when((port == "") | ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(F.coalesce(part("PATH"), F.lit("")), "/{2,}", "/")
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/$", ""))
    params = F.array_sort(F.filter(F.split(F.coalesce(part("QUERY"), F.lit("")), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(TRACKING)))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.when(scheme.isin("http", "https") & host.isNotNull(), F.concat(scheme, F.lit("://"), host, port, path, query)).otherwise(c)


def link_shape(c: Column) -> Column:
    """homepage: the root, a section index or a listing; article: an id, a dated path, a slug of several parts or an opaque id."""
    path, query = F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")), F.coalesce(F.try_parse_url(c, F.lit("QUERY")), F.lit(""))
    article = query.rlike(ID_QUERY) | path.rlike(ARTICLE_PATHS[0]) | path.rlike(ARTICLE_PATHS[1]) | path.rlike(ARTICLE_PATHS[2])
    return F.when(path.rlike(LISTING), "homepage").when(article, "article").when(path.isin("", "/"), "homepage").when(path.rlike(OPAQUE_ID), "article").when(path.rlike(ONE_PART), "homepage").otherwise("article")


def link_safety(c: Column) -> Column:
    """unsafe: not http(s), credentials inside, a private, loopback, link-local, carrier-grade, multicast or metadata host, or a redirector; else ok."""
    host = F.lower(F.try_parse_url(c, F.lit("HOST")))
    octet = lambda i: F.try_element_at(F.transform(F.split(host, r"\."), lambda x: x.try_cast("int")), F.lit(i))
    a, b = octet(1), octet(2)
    numeric = host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    private = a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
    named = host.rlike(r"^(localhost|.*\.(local|internal|localhost)|metadata(\..*)?)$") | host.rlike(r"^\[?(::1|fe80:|f[cd][0-9a-f]{2}:)")
    bad = ~c.rlike("(?i)^https?://") | host.isNull() | F.try_parse_url(c, F.lit("USERINFO")).isNotNull() | (numeric & private) | named | c.rlike(REDIRECT)
    return F.when(F.coalesce(bad, F.lit(True)), "unsafe").otherwise("ok")


def publisher_url(c: Column) -> Column:
    """The publisher's link inside a click tracker's url parameter, or the link itself; '' where neither is usable."""
    plain = F.coalesce(c, F.lit(""))
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    inner = F.try_url_decode(F.regexp_extract(plain, "[?&]url=([^&]+)", 1))
    return F.when(is_usable_link(inner), inner).when(is_usable_link(plain), plain).otherwise("")
