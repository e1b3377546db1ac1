import math

import numpy as np
import pytest

from tallyroom.llm import html_text
from tallyroom.llm.html_text import extract, main_text, smooth

SOUP = """<html><head><title>T</title><style>p{}</style></head><body><div id=top><a href=/>Home</a> <a href=/x>News</a></div>
<div class="site-header"><h2>My Site</h2></div><div class=wrap><ul class="menu"><li><a href=a>One</a><li><a href=b>Two</a></ul>
<div id="content"><h1>Title here</h1><p>First paragraph with quite some text &amp; a <a href=q>link</a> in<b>side</b> of it, long enough.<p>Short.
<p>Another long   paragraph with more words than one could count&nbsp;in a moment.<div class="share-buttons">Share this</div>
<p>Last one of the paragraphs, it also is long enough to count here.</div><div class=sidebar><p>Sidebar text which is long enough to look like a paragraph of content.</p></div>
<div class="comments"><h3>3 comments</h3><p>I think this is a wonderful article and I have read it many times over.</p></div></div>
<div class="footer">(c) 2024 All rights reserved</div><form>Name <input><p>Subscribe to us</p></form><script>var x = "<p>no</p>";</script></body></html>"""

ARTICLE = (
    '<body><div class="cookie-notice">We use cookies to make this site work and it is a long notice text indeed.<nav><ul><li><a href=/>Home</a></ul></nav>'
    "<article><header><h1>A title</h1></header><p>One.<ul><li>First<li>Second</ul><table><tr><td>x<td>y<tr><td>z</table><p>caf&eacute; &#8364;5<br>next"
    '<section class="comment-list"><p>A reader says something long about the article here.</section><footer>By line</footer></article><footer>Foot</footer>'
)


@pytest.mark.parametrize(
    "html, text",
    [
        (SOUP, "Title here First paragraph with quite some text & a link inside of it, long enough. Short. Another long paragraph with more words than one could count in a moment. Last one of the paragraphs, it also is long enough to count here."),
        (ARTICLE, "A title One. First Second x y z café €5 next"),
        ("<body><p>Only a paragraph here of some length.</p><nav>x</nav>", "Only a paragraph here of some length."),
        ("just text", "just text"),
        ("<p>a</b></p></div><p>b", "a b"),
        ("<nav>only a menu</nav>", ""),
        ("<div><", "<"),
        (" \n ", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


def test_long_pages_are_read_whole():
    words = "word " * 60_000
    assert main_text(f"<nav>menu</nav><article><p>{words}</p><p>end</p></article>") == words + "end"
    deep = "<div>" * 3000 + "<p>inside of many containers</p>"
    assert main_text(deep) == "inside of many containers"


def test_smoothing_keeps_means_of_constant_series():
    assert np.allclose(smooth(np.full(7, 3.0)), 3.0)
    assert smooth(np.array([0.0, 9.0, 0.0]))[1] < 9


def test_table(spark, sf):
    from pyspark.sql import functions as F

    rows = [(1, "u", SOUP), (1, "u", SOUP), (2, None, None), (None, "v", ""), (3, "w", "<article>x</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(1)})
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in extract(pages).collect() if r.page_id != 2)
    assert got == sorted((r[0] or 0, r[1], main_text(r[2]), len(main_text(r[2]))) for r in rows if r[0] != 2)
    assert extract(pages.limit(0)).count() == 0


def test_given_pages(spark, sf):
    """Each article holds its page's paragraphs, and none of the menu, advert and footer texts around it."""
    import html as entities
    import re

    for r in extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        assert r.text == " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


BODY = "<p>A first paragraph that has quite a few words in it.</p><p>A second paragraph, which is just as long as the first one.</p>"
PLAIN = "A first paragraph that has quite a few words in it. A second paragraph, which is just as long as the first one."


@pytest.mark.parametrize(
    "html",
    [
        f'<body><div class="layout has-sidebar">{BODY}</div>',
        f'<body><div id="content" class="with-sidebar">{BODY}</div>',
        f'<body><main class="with-sidebar">{BODY}</main>',
        f'<body><div class="wrap no-comments">{BODY}</div>',
        f'<body><article class="post tag-menu no-comments">{BODY}</article>',
        f'<body><article><div id="how-to-share-a-notice">{BODY}</div></article>',
        f'<body><div class="widget">{BODY}<div class="sidebar">Other text.</div></div>',
        f'<body><div class="site-wrapper">{BODY}<div class="share-buttons">Share</div></div>',
    ],
)
def test_names_do_not_drop_articles(html):
    assert main_text(html) == PLAIN


def test_headings_are_not_dropped_by_name():
    assert main_text(f'<body><article><h2 id="comments">Title</h2>{BODY}<div class="comments">More</div></article>') == "Title " + PLAIN


LEAD = "This lead stands before the body and tells in some more words what the whole page is going to be about."


@pytest.mark.parametrize(
    "html, text",
    [
        (f'<body><div class="post"><h1>Title</h1><p>{LEAD}</p><div class="body">{BODY * 6}</div></div>', f"Title {LEAD} " + " ".join([PLAIN] * 6)),
        (f"<body><div><h1>Title</h1><p>By line</p><div>{BODY * 6}</div><p>Tail.</p></div>", "Title By line " + " ".join([PLAIN] * 6) + " Tail."),
        (f"<body><h1>Title</h1><p>{LEAD}</p><blockquote>{BODY * 6}</blockquote><p>{LEAD}</p>", f"Title {LEAD} " + " ".join([PLAIN] * 6) + f" {LEAD}"),
        (f'<body><div><ul><li><a href="/">A link</a></ul><div>{BODY}</div></div>', PLAIN),
    ],
)
def test_what_stands_beside_the_largest_container_counts(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize(
    "html",
    [
        f'<body><div class="content has-sidebar">{BODY}</div>',
        f'<body><article class="post comments-open">{BODY}</article>',
        f'<body><article class="category-social post">{BODY}</article>',
        f'<body><main class="topic-reply-page">{BODY}</main>',
        f'<body><article>{BODY.replace("<p>A sec", '<p class="related-work">A sec')}</article>',
        f'<body><article><section id="discussion">{BODY}</section></article>',
    ],
)
def test_names_of_articles_and_their_parts(html):
    assert main_text(html) == PLAIN


def test_doubtful_names_follow_their_neighbours():
    """A part called 'related' stays among paragraphs of its kind, and goes where its text is thin."""
    part = '<div class="related"><p>Some more text of about the length that paragraphs have.</p></div>'
    thin = '<div class="related"><ul><li><b>x</b> <a href="/">One</a></li><li><b>y</b> <a href="/">Two</a></li><li><b>z</b> <a href="/">Three</a></li></ul></div>'
    assert main_text(f"<body><article>{BODY}{part}{BODY}</article>") == f"{PLAIN} Some more text of about the length that paragraphs have. {PLAIN}"
    assert "y Two" not in main_text(f"<body><article>{BODY}{thin}</article>")


def plain_levels(lines):
    """Ratio, smoothing and clusters line by line; lines: (characters, of links, tags, lowered)."""
    ratio = [0.0 if low else (n - links) / max(1, tags) for n, links, tags, low in lines]
    near = lambda k: [j for j in range(k - 2, k + 3) if 0 <= j < len(lines)]
    used = [-1.5 * max(ratio[j] for j in near(k)) if lines[k][3] else ratio[k] for k in range(len(lines))]
    level = []
    for k in range(len(lines)):
        weight = {j: math.exp(-((j - k) ** 2) / 2) for j in near(k)}
        level.append(sum(weight[j] * used[j] for j in weight) / sum(weight.values()))
    above = [x for x in level if x > 0]
    threshold = 0.5 * sum(above) / len(above) if above else math.inf
    high = [x >= threshold for x in level]
    alone = [h and (n - links) / max(1, tags) >= threshold / 2 for h, (n, links, tags, _) in zip(high, lines)]
    run = lambda k, step: k + step if 0 <= k + step < len(lines) and high[k + step] else None
    reaches = lambda k, step: k is not None and (alone[k] or reaches(run(k, step), step))
    return level, [high[k] and reaches(k, -1) and reaches(k, 1) for k in range(len(lines))]


def test_levels_and_clusters_equal_plain_loops():
    rng = np.random.default_rng(11)
    for _ in range(300):
        n = int(rng.integers(1, 30))
        lines = [(int(rng.integers(1, 900)), 0, int(rng.integers(0, 6)), bool(rng.random() < 0.3)) for _ in range(n)]
        if all(x[3] for x in lines):
            continue
        ratio = np.array([(a - b) / max(1, c) for a, b, c, _ in lines])
        low = np.array([x[3] for x in lines])
        level = html_text.levels(ratio, low, np.zeros(n, bool))
        want, chosen = plain_levels(lines)
        assert np.allclose(level, want) and html_text.clusters(level, ratio).tolist() == chosen
        assert (level[low] <= 1e-9).all()


def test_clusters_decide_the_region(monkeypatch):
    """Without names and article elements: of three blocks the dense one is the article; with other levels it isn't."""
    thin = "".join(f'<li><b>n</b> <i>{k}</i> <a href="/{k}">place {k}</a></li>' for k in range(8))
    page = f"<body><div><ul>{thin}</ul></div><div>{BODY * 3}</div><div><ul>{thin}</ul></div>"
    want = " ".join([PLAIN] * 3)
    assert main_text(page) == want
    rng = np.random.default_rng(1)
    monkeypatch.setattr(html_text, "smooth", lambda ratios: rng.random(len(ratios)))
    assert main_text(page) != want


def test_levels_decide_on_the_given_pages(spark, sf, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    before = [main_text(h) for h in pages]
    rng = np.random.default_rng(1)
    monkeypatch.setattr(html_text, "smooth", lambda ratios: rng.random(len(ratios)))
    assert sum(a != b for a, b in zip(before, map(main_text, pages))) > len(pages) / 2


def test_prose_beside_an_advert_in_containers_of_its_own():
    page = f'<body><div><p>{"word " * 52}</p></div><div class="footer">x</div><div><p>{"other " * 44}</p></div></body>'
    assert html_text.main_text(page) == " ".join(["word"] * 52 + ["other"] * 44)


def test_an_article_right_in_the_body_comes_whole():
    page = f"<html><body><nav>menu</nav><h1>Title here</h1><p>A short lead.</p><p>{'long words ' * 20}</p><p>{'more words ' * 25}</p><p>The end.</p><div class='footer'>foot</div></body></html>"
    assert html_text.main_text(page) == " ".join(["Title here A short lead."] + ["long words"] * 20 + ["more words"] * 25 + ["The end."])


def test_lines_beside_lowered_ones_count_by_their_own_ratio():
    ratio, free = np.array([80.0, 0.0, 5.0, 90.0, 2.0]), np.array([True, False, True, True, True])
    none = np.zeros(5, bool)
    level = html_text.levels(ratio, ~free, none)
    assert html_text.beside(ratio, free, none, level).tolist() == [True, False, False, True, False]
    assert not html_text.beside(ratio, np.ones(5, bool), none, level).any()
