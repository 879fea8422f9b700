"""Tags, category paths, account labels and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.money import col_of, plain_money

UNCATEGORIZED = "Uncategorized"


def no_tags() -> Column:
    return F.array().cast("array<string>")


def parse_tags(c: Column | str) -> Column:
    """JSON array text to ARRAY<STRING>; NULL and bad JSON give an empty array."""
    return F.coalesce(F.from_json(col_of(c), "array<string>"), no_tags())


def tags_json(c: Column | str) -> Column:
    return F.to_json(F.coalesce(col_of(c), no_tags()))


def category_path(parent: Column | str, child: Column | str) -> Column:
    return F.concat_ws(" > ", col_of(parent), col_of(child))


def child_of_path(path: Column | str) -> Column:
    return F.trim(F.element_at(F.split(col_of(path), ">"), -1))


def account_label(institution: Column | str, masked: Column | str) -> Column:
    """``<institution> <masked number>``, or the institution alone."""
    return F.concat_ws(" ", col_of(institution), col_of(masked))


def account_ref(label: Column | str, masked: Column | str) -> Column:
    return F.concat(col_of(label), F.lit("_"), F.coalesce(col_of(masked), F.lit("default")))


def float_text(amount: Column | str) -> Column:
    """The text that a float of two decimals has: no zero at the end but the first decimal (12.5, 12.0). For up to 15 digits."""
    return F.regexp_replace(plain_money(amount), r"(\.[0-9])0$", "$1")


def fingerprint(
    ref: Column | str, date: Column | str, description: Column | str, amount: Column | str, float_amounts: bool = False
) -> Column:
    """MD5 of ``ref|date|description|amount``; the amount is its DECIMAL(18,2) text, or with ``float_amounts`` that of a float."""
    text = float_text(amount) if float_amounts else plain_money(amount)
    parts = [col_of(ref), F.date_format(col_of(date), "yyyy-MM-dd"), col_of(description), text]
    return F.md5(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]))


def fingerprint_bytes(c: Column | str) -> Column:
    """The 16 bytes of an MD5 text, half its size where rows are moved; NULL for any other text."""
    return F.when(col_of(c).rlike("^[0-9a-f]{32}$"), F.unhex(col_of(c)))


def fingerprint_text(c: Column | str) -> Column:
    """The MD5 text of ``fingerprint_bytes``."""
    return F.lower(F.hex(col_of(c)))


def clip(c: Column | str, length: int) -> Column:
    return F.substring(F.coalesce(col_of(c), F.lit("")), 1, length)
