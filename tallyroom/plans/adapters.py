"""Views over the given tables in the shapes that the operators take, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ["COMPANY", "MACRO", "RATES", "FX", "OIL", "TOURISM"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mean_cents(col: str):
    """Mean in whole cents, rounded down: integer sums are the same in any order."""
    return F.floor(F.sum(F.round(F.col(col) * 100).cast("long")) / F.count(F.lit(1))) / 100


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, close, volume."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("date"))
        .agg(_mean_cents("o_totalprice").alias("close"), F.count(F.lit(1)).alias("volume"))
    )


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, close of the market index."""
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(_mean_cents("l_extendedprice").alias("close"))


def news(spark: SparkSession, sf_dir: str, days: int = 365) -> DataFrame:
    """Feed rows: one per document, dated over the given number of days."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    return d.select(
        i.alias("id"),
        F.col("lang").alias("panel"),
        F.element_at(F.split("text", "\n", 2), 1).alias("title"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % days).cast("int")).alias("date"),
        F.col("source").alias("source_label"),
        F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "low").otherwise("medium").alias("severity"),
        F.element_at(F.array(*map(F.lit, CATEGORIES)), (i % 6 + 1).cast("int")).alias("category"),
        F.when(i % 5 == 0, None).otherwise((i * 37) % 126).cast("int").alias("display_priority"),
        (i % 11 == 0).alias("hidden"),
        F.when(i % 3 == 0, None).otherwise(i % 3 == 1).alias("show_pin"),
        (i % 13 == 0).alias("chart_marked"),
        F.element_at(F.array(F.lit("positive"), F.lit("negative"), F.lit("neutral")), (i % 3 + 1).cast("int")).alias("impact"),
        F.timestamp_seconds(F.lit(1735689600) + i * 600).alias("fetched_at"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log: one row per event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("started_at"), (F.col("event_type") != "error").alias("ok"), F.concat(F.lit("s"), F.col("user_id") % 7).alias("source"), F.floor("value").cast("int").alias("rows_added")
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, price."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), "ts", F.col("value").alias("price"), F.col("event_id").alias("id"))


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, url, html."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", "html")


def _pick(values: list[str], expr: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({expr} AS INTEGER))"


def news_sql(days: int = 365) -> str:
    return f"""news AS (
        SELECT d.doc_id AS id, lang AS panel, split_part(text, chr(10), 1) AS title,
               DATE '2024-01-01' + CAST(d.doc_id % {days} AS INTEGER) AS date, source AS source_label,
               CASE WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'low' ELSE 'medium' END AS severity,
               {_pick(CATEGORIES, 'd.doc_id % 6 + 1')} AS category,
               CAST(CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE (d.doc_id * 37) % 126 END AS INTEGER) AS display_priority,
               d.doc_id % 11 = 0 AS hidden, CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.doc_id % 3 = 1 END AS show_pin,
               d.doc_id % 13 = 0 AS chart_marked, {_pick(['positive', 'negative', 'neutral'], 'd.doc_id % 3 + 1')} AS impact,
               make_timestamp((1735689600 + d.doc_id * 600) * 1000000) AS fetched_at
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


SQL = {
    "bars": "bars AS (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, floor(sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / count(*)) / 100 AS close, count(*) AS volume FROM orders GROUP BY ALL)",
    "idx": "idx AS (SELECT CAST(l_shipdate AS DATE) AS date, floor(sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / count(*)) / 100 AS close FROM lineitem GROUP BY ALL)",
    "news": news_sql(),
    "news30": news_sql(30),
    "runs": "runs AS (SELECT event_id AS id, ts AS started_at, event_type <> 'error' AS ok, 's' || (user_id % 7) AS source, CAST(floor(value) AS INTEGER) AS rows_added FROM events)",
    "ticks": "ticks AS (SELECT user_id AS symbol, ts, value AS price, event_id AS id FROM events)",
    "crawl": "crawl AS (SELECT page_id AS id, url, html FROM pages)",
}


def with_views(names: str, query: str) -> str:
    """query over the named views; a query may go on with WITH clauses of its own after a leading comma."""
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + ("" if query.lstrip().startswith(",") else " ") + query.strip()
