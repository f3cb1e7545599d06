"""Dates and durations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd", "yyyy-MM", "MM/yyyy", "MMM yyyy", "MMMM yyyy", "dd/MM/yyyy")
OPEN_ENDED = ("present", "current", "now", "till date", "ongoing")


def normalise_date(c: Column) -> Column:
    """struct<date, is_current>: open-ended words give no date, a year range its last year, known formats ISO, else the text."""
    t = F.lower(F.trim(c))
    year_range = F.regexp_extract(t, r"^([0-9]{4})\s*[-–]\s*([0-9]{4})$", 2)
    day = F.when(F.regexp_like(t, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), F.date_format(F.try_to_date(t, "yyyy-MM-dd"), "yyyy-MM-dd"))
    day = F.coalesce(day, F.when(F.regexp_like(t, F.lit("^[0-9]{2}/[0-9]{2}/[0-9]{4}$")), F.date_format(F.try_to_date(t, "dd/MM/yyyy"), "yyyy-MM-dd")))
    title = F.initcap(t)
    month = F.coalesce(
        F.when(F.regexp_like(t, F.lit("^[0-9]{4}-[0-9]{2}$")), F.date_format(F.try_to_date(t, "yyyy-MM"), "yyyy-MM")),
        F.when(F.regexp_like(t, F.lit("^[0-9]{2}/[0-9]{4}$")), F.date_format(F.try_to_date(t, "MM/yyyy"), "yyyy-MM")),
        F.when(F.regexp_like(t, F.lit("^[a-z]{3} [0-9]{4}$")), F.date_format(F.try_to_date(title, "MMM yyyy"), "yyyy-MM")),
        F.when(F.regexp_like(t, F.lit("^[a-z]{4,} [0-9]{4}$")), F.date_format(F.try_to_date(title, "MMMM yyyy"), "yyyy-MM")),
    )
    current = t.isin(*OPEN_ENDED)
    value = F.when(current, F.lit(None).cast("string")).when(year_range != "", year_range).otherwise(F.coalesce(day, month, F.trim(c)))
    return F.struct(value.alias("date"), F.coalesce(current, F.lit(False)).alias("is_current"))


def _months(c: Column, default_month: int) -> Column:
    year = F.try_to_number(F.substring(c, 1, 4), F.lit("9999")).cast("int")
    month = F.when(F.length(c) >= 7, F.try_to_number(F.substring(c, 6, 2), F.lit("99")).cast("int")).otherwise(default_month)
    return year * 12 + month


def months_between(start: Column, end: Column, inclusive: bool = True) -> Column:
    """Whole months of partial ISO dates: a bare start year is January, a bare end year December.

    A negative span is null where both ends count, and 0 where the end does not (the vendor's rule).
    """
    n = _months(end, 12) - _months(start, 1)
    return F.when(n >= -1, n + 1) if inclusive else F.greatest(n, F.lit(0))


def parse_timestamp(c: Column) -> Column:
    """ISO timestamps, with ``Z`` or an offset; anything else is null."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(c), "Z$", "+00:00"))


def format_months(n: Column) -> Column:
    years, months = F.floor(n / 12), n % 12
    part = lambda v, w: F.when(v > 0, F.concat(v.cast("string"), F.lit(f" {w}"), F.when(v == 1, "").otherwise("s")))
    return F.coalesce(F.nullif(F.concat_ws(" ", part(years, "year"), part(months, "month")), F.lit("")), F.when(n == 0, "0 months"))


def parse_experience(c: Column) -> Column:
    """struct<minimum_months, maximum_months, display_value> of '3-5 years', '3+ years' or '3 years'."""
    num = lambda g: F.try_to_number(F.nullif(F.regexp_extract(F.lower(c), r"([0-9]{1,2})\s*(?:(?:-|to)\s*([0-9]{1,2})|(\+))?\s*years?", g), F.lit("")), F.lit("99")).cast("int")
    low, high = num(1), num(2)
    plus = F.regexp_extract(F.lower(c), r"([0-9]{1,2})\s*(?:(?:-|to)\s*([0-9]{1,2})|(\+))?\s*years?", 3) == "+"
    display = F.when(high.isNotNull(), F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" years"))).when(plus, F.concat(low.cast("string"), F.lit("+ years"))).when(low.isNotNull(), F.concat(low.cast("string"), F.lit(" years")))
    return F.struct((low * 12).alias("minimum_months"), (high * 12).alias("maximum_months"), display.alias("display_value"))


def experience_phrase(c: Column) -> Column:
    """struct<minimum_months, maximum_months, display_value> of a job's phrase: a range, 'n+ years', 'minimum n years' or 'n years'; the last three leave the maximum open."""
    num = lambda pattern, g: F.try_to_number(F.nullif(F.regexp_extract(c, pattern, g), F.lit("")), F.lit("999")).cast("int")
    span = r"(?i)([0-9]+)\s*(?:-|–|to)+\s*([0-9]+)\s+years?"
    low = F.coalesce(num(span, 1), *[num(p, 1) for p in (r"(?i)([0-9]+)\+\s*years?", r"(?i)(?:minimum|at\s+least|min\.?)\s+(?:of\s+)?([0-9]+)\s+years?", r"(?i)([0-9]+)\s+years?")])
    return F.struct((low * 12).alias("minimum_months"), (num(span, 2) * 12).alias("maximum_months"), c.alias("display_value"))


def experience_tier(months: Column) -> Column:
    return F.when(months < 24, "0-1").when(months < 72, "2-5").when(months < 132, "6-10").otherwise("11-15")


def experience_category(months: Column) -> Column:
    return F.when(months < 24, "FRESHER").otherwise("EXPERIENCED")
