"""Findings of round 3: inputs on which a query and its SQL, or two sizes, came apart."""

import datetime

import duckdb
import pytest

import tallyroom.plans.more_queries  # noqa: F401
from tallyroom.plans.queries import ORACLE_SQL, QUERIES
from tests.compare import compare, connect


def given(folder, **tables):
    """Tables of SELECT statements as files."""
    for name, sql in tables.items():
        duckdb.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def documents(folder, titles, lang="en"):
    rows = ", ".join(f"({i}, '{t}', '{lang}')" for i, t in titles)
    return given(
        folder, documents=f"SELECT CAST(i AS BIGINT) AS doc_id, t AS text, l AS lang, 'web' AS source, CAST(length(t) AS BIGINT) AS n_chars FROM (VALUES {rows}) v(i, t, l)",
        labels="SELECT CAST(0 AS BIGINT) AS doc_id, CAST(1 AS INTEGER) AS quality, CAST(0 AS INTEGER) AS toxic WHERE false",
    )


def by_id(df):
    return {r[0]: r[1] for r in df.collect()}


def test_crawl_audits_of_missing_pages_and_nameless_titles(spark, tmp_path):
    """titles that tell of a missing page, or have no Latin letter beside the site's name, by the same rule on both sides."""
    titles = ["Error 404 here", "x404y in one word", "Page Not Found", "?????", "ข่าวเด่นวันนี้", "a usual title", "\u00a0abcd"]
    rows = ", ".join(f"({7 * i + k}, '{t}')" for i, t in enumerate(titles) for k in range(7))
    sf = given(tmp_path, pages=f"SELECT CAST(i AS BIGINT) AS page_id, 'https://a.co/' || i AS url, '<title>' || t || '</title>' AS html FROM (VALUES {rows}) v(i, t)")
    assert compare(spark, connect(sf), QUERIES["crawl_audits"], ORACLE_SQL["crawl_audits"], sf) == len(titles) * 7
    got = by_id(QUERIES["crawl_audits"](spark, sf))
    assert [got[7 * i + 2] for i in range(7)] == ["soft_404", "mismatch", "soft_404", "mismatch", "mismatch", "mismatch", "mismatch"]
    assert [got[7 * i + 4] for i in range(7)] == ["soft_404", "valid", "soft_404", "title_unknown", "title_unknown", "valid", "valid"]
    assert got[0] == "dead" and got[6] == "timeout"


@pytest.mark.parametrize("cents", [[6201, 6202, 6200, 6199, 6201, 6202, 6200, 6200], [1, 1, 1, 2] * 2, [100] * 7 + [101]])
def test_intraday_kpi_rounds_exact_halves_up(spark, tmp_path, cents):
    """means that end in an exact half of the fourth decimal."""
    days = [(k, f"2024-01-01 00:00:0{k}", c) for k, c in enumerate(cents)] + [(99, "2024-01-02 00:00:00", 7000)]
    rows = ", ".join(f"({k}, TIMESTAMP '{t}', {c} / 100.0)" for k, t, c in days)
    sf = given(tmp_path, events=f"SELECT CAST(k AS BIGINT) AS event_id, t AS ts, CAST(5 AS BIGINT) AS user_id, 'view' AS event_type, CAST(v AS DOUBLE) AS value, '' AS props FROM (VALUES {rows}) v(k, t, v)")
    assert compare(spark, connect(sf), QUERIES["intraday_kpi"], ORACLE_SQL["intraday_kpi"], sf) == 1
    row = QUERIES["intraday_kpi"](spark, sf).first()
    assert row["asof_close"] == (sum(cents) * 200 + len(cents)) // (2 * len(cents)) / 10000 and row["date"] == datetime.date(2024, 1, 2)


def test_title_verdicts_of_titles_that_name_no_story(spark, tmp_path):
    """F8: placeholders, publishers' names and titles without Latin letters beside the site's name."""
    titles = ["Untitled", "Document", "homepage - ", "Bangkok Post", "...", "ครม. ลดวีซ่า", "news", "|| a usual headline", " ", "\u00a0", "Redirecting | x"]
    sf = documents(tmp_path, enumerate(titles))
    assert compare(spark, connect(sf), QUERIES["title_verdicts"], ORACLE_SQL["title_verdicts"], sf) == len(titles)
    got = by_id(QUERIES["title_verdicts"](spark, sf))
    assert [i for i in range(len(titles)) if got[i] == "match"] == [2, 6, 7, 10]


def test_same_stories_with_repeated_words(spark, tmp_path):
    """words that repeat in either headline count as often as they come in the first."""
    titles = ["alpha alpha alpha beta", "alpha gamma gamma", "alpha delta", "alpha beta gamma delta epsilon", "beta gamma delta", "", "the and", "x y z", "alpha alpha"]
    sf = documents(tmp_path, [(365 * i, t) for i, t in enumerate(titles)])
    assert compare(spark, connect(sf), QUERIES["same_stories"], ORACLE_SQL["same_stories"], sf) == 36
    assert compare(spark, connect(sf), QUERIES["token_overlaps"], ORACLE_SQL["token_overlaps"], sf) == 36


@pytest.mark.parametrize("name", ["same_stories", "token_overlaps"])
def test_pairs_cut_each_title_once(spark, sf, name):
    """titles are cut before the join of a day's rows, not for every pair."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan[: plan.index("Join Inner")]


def test_dice_and_titles_stay_in_their_rows(spark, sf):
    """scoring shuffles no character pairs and joins no scores back."""
    for name, joins in (("dice_scores", 1), ("title_verdicts", 1), ("title_mismatches", 3)):  # of news with labels, twice, and of both
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Aggregate [" not in plan and plan.count("Join ") <= joins, name


def test_dice_counts_repeated_pairs(spark):
    """pairs of characters count as often as both texts have them."""
    from tallyroom.operators.linkjobs import dice_bigram

    rows = [(1, "aaaa", "aa"), (2, "abab", "baba"), (3, "a", "ab"), (4, "", ""), (5, None, "ab"), (6, "ครม", "ครม."), (7, "ab", "cd"), (8, "night", "nacht")]
    got = by_id(dice_bigram(spark.createDataFrame(rows, "id long, a string, b string")))
    assert {k: round(v, 6) for k, v in got.items()} == {1: 0.5, 2: round(4 / 6, 6), 3: 0.0, 4: 0.0, 5: 0.0, 6: 1.0, 7: 0.0, 8: 0.25}
