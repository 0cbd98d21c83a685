"""Dates: tolerant parsing, month ends, fiscal years and reporting cycles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ("M/d/yyyy", "yyyy-MM-dd")


def parse_date(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first format that fits; NULL if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


def nearest_month_end(day: Column) -> Column:
    """This month's end, or the previous month's up to its 15th day."""
    return F.when(F.dayofmonth(day) <= 15, F.last_day(F.add_months(day, -1))).otherwise(F.last_day(day))


def federal_fiscal_year(day: Column, first_month: int = 10) -> Column:
    return F.year(day) + (F.month(day) >= first_month).cast("int")


def fiscal_position(day: Column, first_month: int = 10) -> Column:
    """Fiscal year plus the share of it that has passed."""
    fy = federal_fiscal_year(day, first_month)
    start = F.make_date(fy - 1, F.lit(first_month), F.lit(1))
    return fy + F.datediff(day, start) / F.lit(365.25)


def cycle_month_end(filed: Column, cycle: Column, lead_days: int = 20) -> Column:
    """The latest month end, ``lead_days`` before filing at the latest, whose month is on the cycle (month mod 3)."""
    limit = F.date_sub(filed, lead_days)
    base = F.when(limit == F.last_day(limit), limit).otherwise(F.last_day(F.add_months(limit, -1)))
    ends = [F.last_day(F.add_months(base, -k)) for k in range(3)]
    return F.coalesce(*[F.when(F.month(e) % 3 == cycle, e) for e in ends])


def month_ends(first: Column, last: Column) -> Column:
    """Array of the month ends between two dates, inclusive."""
    months = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    return F.filter(F.transform(months, F.last_day), lambda e: (e >= first) & (e <= last))


def day_gap(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


#: Month names for dates in running text.
MONTHS = "January February March April May June July August September October November December".split()


def text_dates(text: Column) -> Column:
    """Dates written as 'Month day, year' or 'm/d/yy(yy)' in a text; those that are no dates are left out."""
    named = r"(?i)\b((?:" + "|".join(MONTHS) + r")\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4})\b"
    numeric = r"(?<!\d)(\d{1,2}/\d{1,2}/(?:\d{4}|\d{2}))(?!\d)"

    def read(match: Column) -> Column:
        clean = F.regexp_replace(F.regexp_replace(match, r"(?<=\d)(?:st|nd|rd|th)", ""), r"[,\s]+", " ")
        return F.try_to_timestamp(F.initcap(clean), F.lit("MMMM d yyyy")).cast("date")

    def read_numeric(match: Column) -> Column:
        long = F.try_to_timestamp(match, F.lit("M/d/yyyy"))
        return F.when(match.rlike(r"/\d{4}$"), long).otherwise(F.try_to_timestamp(match, F.lit("M/d/yy"))).cast("date")

    found = F.concat(
        F.transform(F.regexp_extract_all(text, F.lit(named), F.lit(1)), read),
        F.transform(F.regexp_extract_all(text, F.lit(numeric), F.lit(1)), read_numeric),
    )
    return F.filter(found, lambda d: d.isNotNull())


def nearest_gap(days: Column, target: Column) -> Column:
    """Least distance in days of any date of an array from ``target``; NULL without dates."""
    return F.array_min(F.transform(days, lambda d: F.abs(F.datediff(d, target))))
