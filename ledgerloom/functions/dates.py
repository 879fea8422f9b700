"""Dates: statement text, month keys and report periods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.money import col_of

# Shape of a date text and the patterns tried on it, in this order.
# Month-first wins over day-first for an ambiguous text such as 03/04/2025.
DATE_SHAPES = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ["yyyy-M-d"]),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ["M/d/yyyy", "d/M/yyyy"]),
    (r"^[A-Za-z]{3,9}\s+\d{1,2},\s+\d{4}$", ["MMM d, yyyy", "MMMM d, yyyy"]),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ["yyyy/M/d"]),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", ["d-MMM-yyyy"]),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ["M-d-yyyy"]),
]

# Report periods.
PERIODS = [
    "Last 30 Days",
    "This Month",
    "Last Month",
    "Last 3 Months",
    "Last 6 Months",
    "This Year",
]


def parse_date(c: Column | str) -> Column:
    """Statement text to DATE, NULL where no format fits.

    Each parser runs only on text of its own shape, so a well-formed column costs
    one parse per row rather than up to eight failing ones.
    """
    text = F.trim(col_of(c))
    chain = F.lit(None).cast("date")
    for shape, patterns in reversed(DATE_SHAPES):
        # Only texts with a month name have inner blanks; a run of them counts as one.
        body = F.regexp_replace(text, r"\s+", " ") if r"\s" in shape else text
        chain = F.when(text.rlike(shape), F.coalesce(*[F.try_to_date(body, p) for p in patterns])).otherwise(chain)
    return chain


def month_key(c: Column | str) -> Column:
    return F.date_format(col_of(c), "yyyy-MM")


def month_start(c: Column | str | dt.date) -> Column:
    """First day of the month of a date, a ``yyyy-MM`` text literal or a column."""
    if isinstance(c, dt.date):
        return F.lit(c.replace(day=1))
    if isinstance(c, str):
        year, month = c.split("-")[:2]
        return F.lit(dt.date(int(year), int(month), 1))
    return F.trunc(c, "MM")


def previous_month(month: Column) -> Column:
    return F.add_months(month, -1)


def resolve_period(
    name: str, today: Column | dt.date, custom: tuple[dt.date, dt.date] | None = None
) -> tuple[Column, Column]:
    """(start, end) of a named period, both inclusive.

    With a literal ``today`` the result folds to two constants that reach the scan.
    """
    now = F.lit(today) if isinstance(today, dt.date) else today
    first = F.trunc(now, "MM").cast("date")
    if name == "Last 30 Days":
        return F.date_sub(now, 30), now
    if name == "This Month":
        return first, F.last_day(now)
    if name == "Last Month":
        before = F.date_sub(first, 1)
        return F.trunc(before, "MM").cast("date"), before
    if name == "Last 3 Months":
        return F.trunc(F.date_sub(first, 90), "MM").cast("date"), now
    if name == "Last 6 Months":
        return F.trunc(F.date_sub(first, 180), "MM").cast("date"), now
    if name == "This Year":
        return F.trunc(now, "YEAR").cast("date"), now
    if name == "Custom":
        start, end = custom or (None, None)
        return (F.lit(start) if start else first), (F.lit(end) if end else now)
    raise ValueError(f"unknown period: {name}")


def month_grid(today: Column | dt.date) -> Column:
    """Array of the 36 month starts of last year, this year and next year."""
    now = F.lit(today) if isinstance(today, dt.date) else today
    january = F.trunc(now, "YEAR").cast("date")
    return F.sequence(F.add_months(january, -12), F.add_months(january, 23), F.expr("interval 1 month"))


def days_between(start: Column, end: Column) -> Column:
    """Days of a period as a divisor: never below 1."""
    return F.greatest(F.datediff(end, start), F.lit(1))
