"""Date columns: eras, local days, plausibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Bangkok"
#: Months whose 15th is what an invented date tends to be.
PLACEHOLDER_MONTHS = (2, 5, 6, 8, 11)


def normalize_era(c: Column) -> Column:
    """Text that starts with a date in a year over 2100 (Buddhist era) has 543 years subtracted; the rest is kept."""
    year = F.regexp_extract(c, r"^([0-9]{4})-[0-9]{2}-[0-9]{2}", 1)
    shifted = F.concat((F.try_to_number(year, F.lit("9999")).cast("int") - 543).cast("string"), F.substr(c, F.lit(5)))
    return F.when((year != "") & (F.try_to_number(year, F.lit("9999")) > 2100), shifted).otherwise(c)


def local_date(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def is_placeholder(c: Column) -> Column:
    return (F.dayofmonth(c) == 15) & F.month(c).isin(*PLACEHOLDER_MONTHS)


def is_fabricated_date(c: Column, today) -> Column:
    """The 15th of a placeholder month, the first of June, the future, or before 2000."""
    june = (F.month(c) == 6) & (F.dayofmonth(c) == 1)
    return is_placeholder(c) | june | (c > F.lit(today).cast("date")) | (c < F.lit("2000-01-01").cast("date"))


def is_suspect_date(c: Column, today, ipo) -> Column:
    """The 15th of a placeholder month, the future, or before the listing."""
    return is_placeholder(c) | (c > F.lit(today).cast("date")) | (c < F.lit(ipo).cast("date"))


def market_open(ts: Column, is_holiday: Column) -> Column:
    """10:00 to 17:30 local time, both included, Monday to Friday, not on a holiday."""
    local = F.from_utc_timestamp(ts, ZONE)
    minute = F.hour(local) * 60 + F.minute(local)
    return ~F.dayofweek(local).isin(1, 7) & ~is_holiday & minute.between(600, 1050)


def first_date(*texts: Column) -> Column:
    """The first of the texts that is a date YYYY-MM-DD, era folded."""
    return F.coalesce(*(F.try_to_date(F.regexp_extract(normalize_era(t), r"^\s*([0-9]{4}-[0-9]{2}-[0-9]{2})\s*$", 1), "yyyy-MM-dd") for t in texts))


def period_gate(c: Column, year: Column, today) -> Column:
    """Whether a date lies between October of the year before and March of the year after, and not in the future."""
    return (c >= F.make_date(year - 1, F.lit(10), F.lit(1))) & (c <= F.make_date(year + 1, F.lit(3), F.lit(31))) & (c <= F.lit(today).cast("date"))


def item_date(c: Column) -> Column:
    """The date that a historical item states: YYYY-MM-DD, or YYYY-MM for the middle of the month (day 15); brackets go; null for anything else."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\[\]]", ""))
    text = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.concat(text, F.lit("-15"))).otherwise(text)
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
