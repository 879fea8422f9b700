"""Predicates on the ledger view, sorting and paging."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import UNCATEGORIZED, no_tags

# Fixed values.
PAGE_SIZE = 25
NOT_INCOME_OR_EXPENSE = ("Transfer", "Credit Card Payment")

# A page's part of the rows is narrowed until it has so many at most, each time into so many ranges.
SORT_ROWS = 20_000
RANGES = 64


def _lit(value: Column | dt.date) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def between_dates(
    df: DataFrame, start: Column | dt.date | None = None, end: Column | dt.date | None = None, column: str = "date"
) -> DataFrame:
    """Inclusive range; either end may be open."""
    if start is not None:
        df = df.filter(F.col(column) >= _lit(start))
    if end is not None:
        df = df.filter(F.col(column) <= _lit(end))
    return df


def by_account(df: DataFrame, ids: Sequence[int]) -> DataFrame:
    return df.filter(F.col("account_id").isin(list(ids)))


def by_category(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Matches after the default is filled, so "Uncategorized" can be asked for."""
    return df.filter(F.coalesce(F.nullif("category", F.lit("")), F.lit(UNCATEGORIZED)).isin(list(names)))


def by_category_strict(df: DataFrame, name: str) -> DataFrame:
    """Matches the joined child name, so rows without a category never match."""
    return df.filter(F.col("child_cat_name") == name)


def search(df: DataFrame, text: str, wildcards: bool = False) -> DataFrame:
    """Description contains the text, any case. With ``wildcards`` % and _ act as in LIKE; a backslash is itself."""
    if wildcards:
        literal = text.replace("\\", "\\\\")
        return df.filter(F.col("description").ilike(f"%{literal}%"))
    return df.filter(F.lower("description").contains(text.lower()))


def with_any_tag(df: DataFrame, tags: Sequence[str]) -> DataFrame:
    wanted = F.array(*[F.lit(t) for t in tags])
    return df.filter(F.coalesce(F.arrays_overlap(F.coalesce("tags", no_tags()), wanted), F.lit(False)))


def by_flow(df: DataFrame, kind: str) -> DataFrame:
    """``expense``: amount < 0; ``income``: amount > 0. Zero is neither."""
    return df.filter({"expense": F.col("amount") < 0, "income": F.col("amount") > 0}[kind])


def by_abs_amount(df: DataFrame, op: str, limit: float) -> DataFrame:
    size = F.abs("amount")
    return df.filter({">": size > limit, "<": size < limit}[op])


def is_transfer() -> Column:
    return F.coalesce(F.col("is_transfer"), F.lit(0)) == 1


def exclude_transfers(df: DataFrame) -> DataFrame:
    return df.filter(~is_transfer())


def only_transfers(df: DataFrame) -> DataFrame:
    return df.filter(is_transfer())


def exclude_categories(df: DataFrame, names: Sequence[str] = NOT_INCOME_OR_EXPENSE) -> DataFrame:
    return df.filter(~F.coalesce(F.col("category"), F.lit(UNCATEGORIZED)).isin(list(names)))


def sort_order(key: str = "date", descending: bool = True) -> list[Column]:
    """The user's key, then newest first and highest id first."""
    first = F.col(key).desc() if descending else F.col(key).asc()
    return [first, F.col("date").desc(), F.col("id").desc()] if key != "date" else [first, F.col("id").desc()]


def sort_ledger(df: DataFrame, key: str = "date", descending: bool = True) -> DataFrame:
    return df.orderBy(*sort_order(key, descending))


def top_n(df: DataFrame, n: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """First n rows, or first n per group. Both keep at most n rows per task before the shuffle."""
    if not by:
        return df.orderBy(*order).limit(n)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def _place(df: DataFrame, column: str) -> Column:
    """A number that never falls along the column's order; for texts, from their first bytes."""
    kind = df.schema[column].dataType.typeName()
    if kind == "date":
        return F.unix_date(column).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if kind in ("string", "binary"):
        start = F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 6)), 12, "0")
        return F.conv(start, 16, 10).cast("double")
    return F.col(column).cast("double")


def _range_number(place: Column, bounds: Sequence[float], first: int = 0) -> Column:
    """How many of the rising bounds lie below the place; NULL where there is none."""
    if not bounds:
        return F.when(place.isNotNull(), F.lit(first))
    mid = len(bounds) // 2
    return F.when(place <= bounds[mid], _range_number(place, bounds[:mid], first)).otherwise(
        _range_number(place, bounds[mid + 1 :], first + mid + 1)
    )


def _parts_of_page(
    df: DataFrame, keys: Sequence[tuple[str, bool]], where: Column, skip: int, take: int, rows: int, sort_rows: int
) -> list[tuple[Column, int, int]]:
    """(condition, rows to skip, rows to take) of the parts of the sorted rows that hold a page, each of ``sort_rows`` rows at most.

    One aggregate finds ranges of the first key with like numbers of rows, and one counts them; of the
    few that hold the page each is narrowed further, by the next key where it is a single value.
    """
    if rows <= sort_rows or not keys:
        return [(where, skip, take)]
    column, descending = keys[0]
    part, place = df.filter(where), _place(df, column)
    shares = [n / RANGES for n in range(RANGES)]
    found = part.agg(F.percentile_approx(place, shares, 1000).alias("bounds")).first()["bounds"]
    number = _range_number(place, sorted(set(found or [])))
    counts = part.groupBy(number.alias("number")).agg(F.count(F.lit(1)).alias("rows"), F.min(column).alias("low"), F.max(column).alias("high"))
    ranges = counts.collect()  # RANGES + 1 rows at most
    if len(ranges) == 1 and ranges[0]["low"] != ranges[0]["high"]:
        return [(where, skip, take)]
    # an ascending order has NULL first, a descending one last
    ranges.sort(key=lambda r: -1 if r["number"] is None else r["number"], reverse=descending)
    parts, before = [], 0
    for r in ranges:
        begin, end = max(skip, before), min(skip + take, before + r["rows"])
        if begin < end:
            single = r["low"] == r["high"]
            inside = F.col(column).isNull() if r["low"] is None else F.col(column).between(F.lit(r["low"]), F.lit(r["high"]))
            parts += _parts_of_page(df, keys[1:] if single else keys, where & inside, begin - before, end - begin, r["rows"], sort_rows)
        before += r["rows"]
    return parts


def page(
    df: DataFrame, number: int, size: int = PAGE_SIZE, key: str = "date", descending: bool = True, sort_rows: int = SORT_ROWS
) -> DataFrame:
    """Page ``number`` (from 1, capped at the last page) of the sorted rows.

    The ranges of the sort keys that hold the page are found by counting, and only their rows are sorted,
    wherever the page lies and however often a key repeats.
    """
    total = df.count()
    pages = max(1, -(-total // size))
    skip = (min(max(number, 1), pages) - 1) * size
    take = min(size, total - skip)
    keys = [(key, descending), ("id", True)] if key == "date" else [(key, descending), ("date", True), ("id", True)]
    order = sort_order(key, descending)
    parts = [
        df.filter(where).orderBy(*order).offset(before).limit(rows)
        for where, before, rows in _parts_of_page(df, keys, F.lit(True), skip, take, total, sort_rows)
    ]
    out = parts[0]
    for other in parts[1:]:
        out = out.unionAll(other)
    return out.orderBy(*order)
