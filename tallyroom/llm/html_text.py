"""Main text of web pages: streaming parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is never main text.
SKIP = frozenset("head script style noscript template iframe object svg canvas audio video map form button select textarea option nav aside footer dialog menu title rp rt".split())
#: They start a line of their own; all other elements are inline.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SCOPES = frozenset("article main section div td body html blockquote center table tbody tr".split())
#: What may end without an end tag, and the start tags that end it.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "p": BLOCK - {"html", "body"}}
#: Implied ends don't reach out of these.
BARRIER = frozenset("html body article main section div blockquote ul ol dl table select form nav aside header footer details".split())
#: Words in class, id, role and label attributes. The first kind always marks what isn't the article; the second
#: unless the same attributes call it content; the third says so.
NEVER = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay toast comment comments commentlist disqus respond replies reply nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidenav share sharing social related recommended recommendations newsletter subscribe subscription signup login pagination pager widget widgets skip masthead topbar toolbar paywall outbrain taboola complementary contentinfo dialog search discussion feedback".split()
)
#: Of these, an article may have parts of its own by such a name.
DOUBTFUL = frozenset("related discussion feedback search complementary dialog".split())
UNLESS_CONTENT = frozenset("header footer head foot site top bottom aside side rail links tags meta byline".split())
CONTENT = frozenset("article content main post entry story body text".split())
#: Attributes that have one of these as a whole name are never dropped for another name.
CONTENT_NAMES = frozenset("article content main".split())
#: Words that a name may have besides: with any other word (has-sidebar, no-comments, a slug) it says nothing.
PARTS = CONTENT | frozenset(
    "list lists button buttons box bar area section wrapper wrap container block group row col column inner outer left right primary secondary page posts articles title form link item items icon icons unit slot zone region panel header footer head foot site top bottom side aside rail links tags meta byline global local mobile desktop sticky fixed this and user email wp js module holder toggle count thread author info message messages".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIGMA, RADIUS = 1.0, 2


class _Element:
    __slots__ = ("article", "doubt", "named", "number", "skip", "tag")

    def __init__(self, tag: str, number: int, skip: str | None, named: tuple[int, ...], article: bool, doubt: bool):
        self.tag, self.number, self.skip, self.named, self.article, self.doubt = tag, number, skip, named, article, doubt


class _Line:
    __slots__ = ("article", "doubt", "heading", "links", "named", "parts", "path", "skip", "tags")

    def __init__(self, path, skip, heading, named, article, doubt):
        self.parts, self.tags, self.links, self.path, self.skip, self.heading = [], 0, 0, path, skip, heading
        self.named, self.article, self.doubt = named, article, doubt


def _words(value: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())


def _names(given: dict) -> list[set[str]]:
    """The words of each name in an element's attributes; a label is one name."""
    values = [v for name in ("class", "id", "role", "itemprop") for v in (given.get(name) or "").split()]
    values += [given.get("aria-label") or "", (given.get("itemtype") or "").rsplit("/", 1)[-1]]
    return [words for v in values if (words := {w for w in _words(v) if len(w) > 1})]


class LineParser(HTMLParser):
    """Turns a page's events into lines: the text between two block tags, with the tags and link characters in it.

    Each line knows its enclosing containers and whether an element that is never main text holds it. End tags that
    match nothing are ignored; an end tag closes what its element has left open.
    """

    def __init__(self, by_name: bool = True, lifted: frozenset[int] = frozenset()):
        """by_name: names drop elements; but not those whose numbers are lifted."""
        super().__init__(convert_charrefs=True)
        self.by_name, self.lifted = by_name, lifted
        self.lines: list[_Line] = []
        self.tags: list[str] = []  # of each element, by number
        self.stack: list[_Element] = []
        self.line: _Line | None = None
        self.in_link, self.pending = 0, 1
        self.seen_article = False

    def _break(self):
        self.line = None

    def _pop(self, upto: int):
        for e in self.stack[upto:]:
            if e.tag == "a":
                self.in_link -= 1
            if e.tag in BLOCK or e.tag in SKIP:
                self._break()
        del self.stack[upto:]

    def handle_starttag(self, tag, attrs):
        if tag == "br" or tag == "wbr":
            if self.line is not None:
                self.line.tags += 1
                if tag == "br":
                    self.line.parts.append(" ")
            return
        if tag in VOID:
            self.pending += 1
            if tag == "hr":
                self._break()
            return
        cut = None
        for k in range(len(self.stack) - 1, -1, -1):
            if tag in IMPLIED.get(self.stack[k].tag, ()):
                cut = k
            elif self.stack[k].tag in BARRIER:
                break
        if cut is not None:
            self._pop(cut)
        if tag in BLOCK or tag in SKIP:
            self._break()
        self.pending += 1
        if self.line is not None:
            self.line.tags += 1
        skip = self.stack[-1].skip if self.stack else None
        own = self._reason(tag, attrs)
        if tag in ("article", "main") and own in (None, "doubt") and skip in ("div", "header") and not self.seen_article:
            skip = None  # a wrapper that nobody closed
        if tag in ("article", "main"):
            self.seen_article = self.seen_article or own in (None, "doubt") and not skip
        number, above = len(self.tags), self.stack[-1] if self.stack else None
        named = above.named if above else ()
        if own == "div":
            named = (*named, number)
        doubt = bool(above and above.doubt) or own == "doubt"
        self.stack.append(_Element(tag, number, skip or (None if own == "doubt" else own), named, tag in ("article", "main") or bool(above and above.article), doubt))
        self.tags.append(tag)
        if tag == "a":
            self.in_link += 1

    def _reason(self, tag: str, attrs) -> str | None:
        inside = bool(self.stack) and self.stack[-1].article
        if tag in SKIP or tag == "header" and not inside:
            return tag
        if tag in ("html", "body"):
            return None
        given = dict(attrs)
        if "hidden" in given or (given.get("aria-hidden") or "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style") or "", re.I):
            return "hidden"
        if not self.by_name or tag in HEADINGS or len(self.tags) in self.lifted:
            return None
        names = _names(given)
        if any(len(words) == 1 and words & CONTENT_NAMES for words in names):
            return None
        never = [words for words in names if words & NEVER and words <= NEVER | PARTS]
        if never and inside and set().union(*never) & NEVER <= DOUBTFUL:
            return "doubt"
        if never:
            return "comment" if set().union(*never) & {"comment", "comments", "commentlist", "disqus", "replies", "discussion"} else "div"
        if not inside and not any(words & CONTENT for words in names) and any(words & UNLESS_CONTENT and words <= NEVER | PARTS for words in names):
            return "div"
        return None

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:  # in HTML the slash means nothing
            self.handle_starttag(tag, attrs)
            if tag in self.CDATA_CONTENT_ELEMENTS or tag in ("svg", "path", "span", "i", "a"):
                self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.pending += 1
        if tag == "br":
            self.handle_starttag("br", [])
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                self._pop(k)
                break
            if tag not in SCOPES and tag not in SKIP and self.stack[k].tag in ("article", "main", "body", "td"):
                break  # an inline end tag doesn't reach out of its container
        if tag in BLOCK:
            self._break()
        elif self.line is not None:
            self.line.tags += 1

    def handle_data(self, data):
        if not data:
            return
        if self.line is None:
            if not data.strip():
                return
            top = self.stack[-1].skip if self.stack else None
            path = tuple(e.number for e in self.stack if e.tag in SCOPES)
            named, article, doubt = (self.stack[-1].named, self.stack[-1].article, self.stack[-1].doubt) if self.stack else ((), False, False)
            self.line = _Line(path, top, any(e.tag in HEADINGS for e in self.stack[-3:]), named, article, doubt)
            self.line.tags, self.pending = self.pending, 0
            self.lines.append(self.line)
        self.line.parts.append(data)
        if self.in_link:
            self.line.links += len(data)


def smooth(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; at the ends the weights in reach count alone."""
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    wide = np.convolve(ratios, weights)[radius : radius + len(ratios)]
    return wide / np.convolve(np.ones(len(ratios)), weights)[radius : radius + len(ratios)]


#: What a doubtful name leaves of a line's ratio.
DOUBT = 0.25


def levels(ratio: np.ndarray, lowered: np.ndarray, doubt: np.ndarray) -> np.ndarray:
    """Smoothed text-to-tag ratios. The lines of menus, adverts and the like are lowered below zero before, by half
    as much again as the largest ratio in reach, so that no neighbours lift them; doubtful ones keep a quarter, so that these decide."""
    own = np.where(lowered, 0.0, np.where(doubt, DOUBT * ratio, ratio))
    reach = np.pad(own, RADIUS)
    largest = np.max([reach[k : k + len(own)] for k in range(2 * RADIUS + 1)], axis=0)
    return smooth(np.where(lowered, -1.5 * largest, own))


def clusters(level: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """The lines in clusters: runs of lines whose level reaches the threshold, half the mean of the levels above zero, each
    from its first to its last line with half the threshold on its own: smoothing spills over the ends."""
    above = level[level > 0]
    out = np.zeros(len(level), bool)
    if not len(above):
        return out
    threshold = 0.5 * above.mean()
    high = np.flatnonzero(np.diff(np.concatenate([[False], level >= threshold, [False]]).astype(np.int8)))
    for start, end in zip(high[::2].tolist(), high[1::2].tolist(), strict=True):
        own = np.flatnonzero(ratio[start:end] >= 0.5 * threshold)
        if len(own):
            out[start + own[0] : start + own[-1] + 1] = True
    return out


def beside(ratio: np.ndarray, free: np.ndarray, doubt: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Lines near a lowered one, which pulls their level down: they count by their own ratio, if it reaches the mean of the levels above zero."""
    above = level[level > 0]
    low = np.pad(~free, RADIUS)
    near = np.any([low[k : k + len(free)] for k in range(2 * RADIUS + 1)], axis=0)
    return near & free & ~doubt & (ratio >= (above.mean() if len(above) else np.inf))


def _parse(html: str, **rules) -> tuple[LineParser, list[tuple[_Line, str]]]:
    parser = LineParser(**rules)
    parser.feed(html)
    parser.close()
    lines = [(x, " ".join("".join(x.parts).split())) for x in parser.lines]
    return parser, [(x, text) for x, text in lines if text]


def _lines(html: str) -> tuple[LineParser, list[tuple[_Line, str]]]:
    """Names don't drop what holds most of the text of a page without text in an article, nor all that a page has."""
    parser, lines = _parse(html)
    if not any(x.skip is None and x.article for x, _ in lines):
        mass: dict[int, int] = {}
        for x, text in lines:
            for number in x.named if x.skip == "div" else ():
                mass[number] = mass.get(number, 0) + len(text)
        total = sum(len(text) for x, text in lines if x.skip in (None, "div"))
        lifted = frozenset(number for number, m in mass.items() if 2 * m > total)
        if lifted:
            parser, lines = _parse(html, lifted=lifted)
    if not any(x.skip is None for x, _ in lines):
        parser, lines = _parse(html, by_name=False)
    return parser, lines


def main_text(html: str | None) -> str:
    """The article of a page; white space inside a block is one space, and so is what joins blocks.

    Lines whose smoothed text-to-tag ratio reaches a threshold form clusters. Menus, headers, footers, sidebars, notices,
    adverts, forms and comment sections have their ratio lowered by their tags and names; link text counts as none. The
    innermost article or main element with at least three quarters of the clusters' levels is the content region; elsewhere
    it is the innermost container of all clusters, what isn't links alone in the containers around it and between the first
    cluster and the last, and headings right before them. Where all clusters stand right in the body, the region is what stands there, outside of
    all containers. On pages without article and main elements, a line beside a lowered one counts by its own ratio. In the region all lines count that are not lowered, short ones too, and
    lowered or doubtful ones where they reach a cluster.
    """
    if not html:
        return ""
    parser, lines = _lines(html)
    free = np.array([x.skip is None for x, _ in lines], bool)
    if not free.any():
        return ""
    size = np.array([len(text) for _, text in lines], float)
    ratio = (size - [min(x.links, len(text)) for x, text in lines]) / [max(1, x.tags) for x, _ in lines]
    doubt = np.array([x.doubt for x, _ in lines], bool)
    level = levels(ratio, ~free, doubt)
    chosen = clusters(level, ratio)
    pulled = beside(ratio, free, doubt, level) & ~chosen
    if pulled.any() and not any(x.article for x, _ in lines):  # an article or main element holds its lines together by itself
        level, chosen = np.where(pulled, ratio, level), chosen | pulled
    if not chosen.any():
        level, chosen = np.where(free, 1.0, 0.0), free
    counts = (free & ~doubt) | chosen
    mass: dict[int, float] = {}
    for i in np.flatnonzero(chosen):
        for number in lines[i][0].path:
            mass[number] = mass.get(number, 0) + level[i]
    total = level[chosen].sum()
    articles = [number for number, m in mass.items() if m >= 0.75 * total and parser.tags[number] in ("article", "main")]
    if articles:  # the innermost article, or else the innermost main element
        best = max(articles, key=lambda number: (parser.tags[number] == "article", number))
        return " ".join(text for k, (x, text) in enumerate(lines) if counts[k] and best in x.path)
    where = np.flatnonzero(chosen)
    worth = [bool(counts[k]) and (x.heading or x.links < 0.8 * len(text)) for k, (x, text) in enumerate(lines)]
    # All clusters lie in these, outermost first; the page itself is none of them.
    within = set(lines[where[0]][0].path).intersection(*(lines[k][0].path for k in where))
    holders = [number for number in lines[where[0]][0].path if number in within and parser.tags[number] not in ("html", "body")]
    inner = holders[-1] if holders else None
    best = set(where.tolist())
    if inner is None and all(parser.tags[lines[k][0].path[-1]] == "body" for k in where if lines[k][0].path) and all(lines[k][0].path for k in where):
        # An article right in the page's body: what else stands there, and in no container of its own, is part of it.
        best |= {k for k, (x, _) in enumerate(lines) if counts[k] and x.path == lines[where[0]][0].path}
    if inner is not None:
        best |= {k for k, (x, _) in enumerate(lines) if counts[k] and inner in x.path}
        best |= {k for k, (x, _) in enumerate(lines) if worth[k] and holders[0] in x.path}
    first, last = min(best), max(best)
    while first and free[first - 1] and lines[first - 1][0].heading:
        first -= 1
    return " ".join(text for k, (x, text) in enumerate(lines) if k in best or first <= k <= last and worth[k])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html) for html in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars (code points).

    Null and empty html, and pages without main text, give the empty text. Rows are independent, so repeated rows
    give repeated results, and an empty table none; extra columns are not read. There is no shuffle.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
