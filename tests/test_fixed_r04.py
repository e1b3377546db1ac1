"""Findings of round 4: a query beside its SQL, and work per pair."""

import pytest

import tallyroom.plans.more_queries  # noqa: F401
from tallyroom.plans.queries import ORACLE_SQL, QUERIES
from tests.compare import compare, connect
from tests.test_fixed_r03 import given


def ticks(folder, rows):
    """(user, time, value as SQL) as events."""
    values = ", ".join(f"({k}, {u}, TIMESTAMP '{t}', {v})" for k, (u, t, v) in enumerate(rows))
    return given(folder, events=f"SELECT CAST(k AS BIGINT) AS event_id, t AS ts, CAST(u AS BIGINT) AS user_id, 'view' AS event_type, CAST(v AS DOUBLE) AS value, '' AS props FROM (VALUES {values}) v(k, u, t, v)")


@pytest.mark.parametrize("close, price, change", [("0.00", "38.63", None), ("0.00", "0.00", None), ("320.00", "115.86", -63.7938), ("320.00", "115.98", -63.7563), ("300.00", "299.9999", 0.0), ("-2.00", "1.00", -150.0), ("-2.00", "-3.00", 50.0)])
def test_intraday_kpi_of_zero_closes_and_exact_halves(spark, tmp_path, close, price, change):
    """no change against a close of 0, halves of the fourth decimal away from zero, no zero with a sign, on both sides."""
    sf = ticks(tmp_path, [(1, "2024-01-01 00:00:00", close), (1, "2024-01-02 00:00:00", price)])
    compare(spark, connect(sf), QUERIES["intraday_kpi"], ORACLE_SQL["intraday_kpi"], sf)
    for got in (QUERIES["intraday_kpi"](spark, sf).first()["change"], connect(sf).execute(ORACLE_SQL["intraday_kpi"]).fetchall()[0][4]):
        assert repr(got) == repr(change)


def test_intraday_kpi_of_ticks_without_price_or_symbol(spark, tmp_path):
    """a later tick without price doesn't move the day; keys without a price and rows without a key stay."""
    sf = ticks(tmp_path, [(1, "2024-01-01 00:00:00", "5"), (1, "2024-01-02 00:00:00", "6"), (1, "2024-01-03 00:00:00", "NULL"), (2, "2024-01-01 00:00:00", "NULL"), ("NULL", "2024-01-01 00:00:00", "7")])
    assert compare(spark, connect(sf), QUERIES["intraday_kpi"], ORACLE_SQL["intraday_kpi"], sf) == 3
    got = {r.ticker: (r.price, r.asof_close, r.change) for r in QUERIES["intraday_kpi"](spark, sf).collect()}
    assert got == {1: (6.0, 5.0, 20.0), 2: (None, None, None), None: (7.0, None, None)}


def test_titles_are_cut_once(spark, sf):
    """what asks for shingles makes Spark cut no title again."""
    from tallyroom.operators import dedup
    from tallyroom.plans.adapters import news

    plan = dedup.story_rows(dedup.headline_keys(news(spark, sf, 10)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?=(.{3}))") == 1


def test_the_loop_over_pairs_is_compiled(spark, sf, capsys):
    """the join is one method of generated code that is small enough for the compiler, and reads no arrays."""
    import re

    from tallyroom.operators import dedup
    from tallyroom.operators.scratch import Kept
    from tallyroom.plans.adapters import news

    rows = dedup.story_rows(dedup.headline_keys(news(spark, sf, 10)))
    here, there, may, common, need = dedup._meeting(rows, None, 48, Kept(spark, "compiled"))
    assert not any(x in may for x in ("array", "size(", "rest", "numbers"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dedup._alike(here, there, may, common, need).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    out = capsys.readouterr().out
    subtree = next(x for x in out.split("== Subtree ")[1:] if re.search(r"\*\(\d+\) SortMergeJoin", x.split("Generated code")[0]))
    assert int(re.search(r"maxMethodCodeSize:(\d+)", subtree)[1]) < 8_000


def test_a_panel_has_its_own_frequent_shingles(spark):
    """shingles that are rare in the whole are bits where they are frequent."""
    import datetime

    from tallyroom.operators import dedup
    from tallyroom.operators.scratch import Kept

    day = datetime.date(2026, 1, 1)
    many = [(i, "many", f"{i:05} alpha beta gamma {i * 7919:07}", day, "s") for i in range(900)]
    few = [(10_000 + i, "few", "an altogether other story of weather", day, "s") for i in range(3)]
    rows = dedup.story_rows(dedup.headline_keys(spark.createDataFrame(many + few, "id long, panel string, title string, date date, source_label string")))
    (packed,) = dedup._packed(rows, Kept(spark, "panels"))
    assert packed.where("panel = 'few'").selectExpr("max(size(rest)) as n").first()["n"] <= 3  # slots taken by others


def test_token_overlaps_of_contained_repeated_and_long_tokens(spark, tmp_path):
    """tokens inside longer words, repeats, words too long to be looked up by their parts, titles without tokens."""
    from tests.test_fixed_r03 import documents

    long = "".join(f"abcd{i}wxyz" for i in range(12))
    titles = ["abcd", "xabcdx yz", "abcd abcd abcd zzzz", "wxyz0 " * 37 + "efgh", long, f"{long} abcd", f"{long[:70]} other", "an of", "", "🙂éabcd abc🙂éabcd", "zzzzz abcd0 0wxyz " * 9, "abcd11wxyz efghefgh"]
    sf = documents(tmp_path, [(365 * i, t.strip()) for i, t in enumerate(titles)])
    assert compare(spark, connect(sf), QUERIES["token_overlaps"], ORACLE_SQL["token_overlaps"], sf) == 66


def test_token_overlaps_search_no_text_for_a_pair(spark, sf):
    """a pair intersects hashes; headlines are searched only against those with a very long word."""
    plan = QUERIES["token_overlaps"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("array_intersect") < plan.index("Contains(") if "Contains(" in plan else "array_intersect" in plan
