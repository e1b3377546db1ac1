"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, odd characters."""

LONG = "alpha beta gamma delta " * 3000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. And runs away.", "en", "s1"),
    (2, "the quick brown fox jumps over the lazy dog. and runs away.", "en", "s1"),
    (3, None, None, None),
    (4, "", "en", "s1"),
    (5, LONG, "en", "s2"),
    (6, LONG.upper(), "en", "s2"),
    (7, "Ünïcode ÉTÉ ß 中文字 🙂   x\x1cy l'été don't", "fr", "s3"),
    (7, "Ünïcode ÉTÉ ß 中文字 🙂   x\x1cy l'été don't", "fr", "s3"),
    (8, "   \t\n ", "en", "s1"),
    (9, "word", "en", "s1"),
    (10, "x" * 20_000, "en", "s1"),
    (11, "ab" * 5_000 + "!" * 500, "en", "s1"),
    (None, "a row without an id", "en", None),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def docs(spark, rows=ROWS):
    """With extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    names = ("start", "score", "kept", "group_size", "component_id", "digest", "n", "id", "block_no", "ids", "_kept_id")
    return df.withColumns({n: F.lit("clash") for n in names})
