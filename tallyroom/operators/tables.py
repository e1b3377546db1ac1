"""Table upkeep without in-place updates: every function returns the new table, and the writer swaps it in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scan_daily(df: DataFrame, panel: str | None = None, start=None, end=None, key: str = "ticker") -> DataFrame:
    """Rows of a panel between two dates, either of which may be missing, in date order."""
    out = df if panel is None else df.where(F.col(key) == panel)
    out = out if start is None else out.where(F.col("date") >= F.lit(start).cast("date"))
    return (out if end is None else out.where(F.col("date") <= F.lit(end).cast("date"))).orderBy(key, "date")


def upsert(target: DataFrame, updates: DataFrame, on: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """updates win on equal keys; for keep_old columns only where they bring a value. Keys are unique in either table."""
    columns = [c for c in target.columns if c not in on]
    new = updates.select(*on, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_hit"))
    value = lambda c: F.coalesce(f"_new_{c}", c) if c in keep_old else F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c))
    return target.join(new, on, "full_outer").select(*on, *(value(c).alias(c) for c in columns))


def upsert_stats(target: DataFrame, updates: DataFrame, on: list[str], by: str) -> DataFrame:
    """Per panel how many keys of the updates are new, and how many there are already."""
    have = target.select(*on, F.lit(True).alias("_have")).dropDuplicates(on)
    joined = updates.join(have, on, "left")
    return joined.groupBy(by).agg(F.count_if(F.col("_have").isNull()).alias("added"), F.count_if("_have").alias("updated"))


def insert_new(target: DataFrame, rows: DataFrame, on: list[str], order: str = "id") -> DataFrame:
    """The rows to append: the first of each key that the target doesn't have."""
    w = Window.partitionBy(*on).orderBy(order)
    first = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return first.join(target.select(*on), on, "left_anti")


def skip_known(rows: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(stored.select(*on), on, "left_anti")


def ensure_rows(target: DataFrame, keys: DataFrame, days_off: DataFrame, key: str = "ticker") -> DataFrame:
    """target and key-only rows for the trading days among keys that it lacks; malformed dates are skipped."""
    from tallyroom.operators.prices import with_day_label

    wanted = with_day_label(keys.withColumn("date", F.try_to_date(F.col("date").cast("string"), "yyyy-MM-dd")).where("date is not null"), days_off).where("label = 'gap'").select(key, "date").distinct()
    return target.unionByName(wanted.join(target.select(key, "date"), [key, "date"], "left_anti"), allowMissingColumns=True)


def patch_column(target: DataFrame, patch: DataFrame, on: list[str], col: str, guard=None) -> DataFrame:
    """Replaces one column where the patch has the key and the guard holds."""
    p = patch.select(*on, F.col(col).alias("_patch"), F.lit(True).alias("_hit"))
    use = F.coalesce(F.col("_hit"), F.lit(False)) & (F.lit(True) if guard is None else guard)
    columns = target.columns
    return target.join(p, on, "left").withColumn(col, F.when(use, F.col("_patch")).otherwise(F.col(col))).select(*columns)


def append_remark(target: DataFrame, pins: DataFrame, on: list[str]) -> DataFrame:
    """The pin on a new line after a row's remark, or as its remark; a category only where there is none."""
    p = pins.select(*on, F.col("remark").alias("_remark"), F.col("category").alias("_category"))
    columns = target.columns
    out = target.join(p, on, "left").withColumns({"remark": F.when(F.col("_remark").isNull(), F.col("remark")).otherwise(F.concat_ws("\n", "remark", "_remark")), "category": F.coalesce("category", "_category")})
    return out.select(*columns)


def append_runs(target: DataFrame, runs: DataFrame, on: str = "id") -> DataFrame:
    """The log with new runs; a repeated batch adds nothing."""
    return target.unionByName(runs.dropDuplicates([on]).join(target.select(on), on, "left_anti"), allowMissingColumns=True)


def delete_rows(target: DataFrame, ids: DataFrame, previewed: int | None = None, on: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows that stay and rows that go. With a previewed count, another number of victims is an error."""
    victims = target.join(ids.select(on).distinct(), on, "left_semi")
    if previewed is not None and (n := victims.count()) != previewed:
        raise ValueError(f"{n} rows would go, {previewed} were previewed")
    return target.join(ids.select(on).distinct(), on, "left_anti"), victims


def ensure_columns(df: DataFrame, spec: dict[str, tuple[str, object]]) -> DataFrame:
    """Missing columns with their type and default; existing values are never rewritten."""
    return df.withColumns({name: F.lit(default).cast(kind) for name, (kind, default) in spec.items() if name not in df.columns})


def upsert_digest(target: DataFrame, updates: DataFrame, on: tuple[str, ...] = ("panel", "date"), order: str = "generated_at") -> DataFrame:
    """Digests after an upsert: each key's last update replaces the stored row whole, empty columns included."""
    w = Window.partitionBy(*on).orderBy(F.desc_nulls_last(order))
    last = updates.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*target.columns)
    return target.join(last.select(*on), list(on), "left_anti").unionByName(last)


def link_defaults(rows: DataFrame) -> DataFrame:
    """Link columns of rows to insert: unchecked without a status, no attempts, verified as given or where the status is valid."""
    status = F.coalesce("source_url_status", F.lit("unchecked"))
    verified = F.coalesce("url_verified", F.coalesce(F.col("source_url_status") == "valid", F.lit(False)))
    return rows.withColumns({"url_verified": verified, "source_url_status": status, "source_url_check_attempts": F.coalesce("source_url_check_attempts", F.lit(0))})
