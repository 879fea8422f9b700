"""Money as text and as DECIMAL(18,2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_amount(c: Column | str) -> Column:
    """Statement text to money: drops ``,``, ``$`` and blanks, ``(x)`` is negative.

    NULL and text that is no number give 0. A number too wide for DECIMAL(18,2)
    gives NULL, so that ``split_rejects`` can put the row aside.
    """
    return _parse_bare(_bare(col_of(c)))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"[,$\s]", "")


def _parse_bare(bare: Column) -> Column:
    inner = F.substring(bare, F.lit(2), F.length(bare) - 2)
    bracketed = F.when(bare.endswith(")"), -inner.try_cast(MONEY))
    parsed = F.when(bare.startswith("("), bracketed).otherwise(bare.try_cast(MONEY)).cast(MONEY)
    too_wide = F.coalesce(bare.rlike(r"\d{17}|\d[eE]\+?\d\d"), F.lit(False))
    return F.coalesce(parsed, F.when(~too_wide, F.lit(0).cast(MONEY)))


def clean_amounts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replaces several text columns by their money.

    One function over an array: parsing each column by an expression of its own would
    make the generated method too large for the JIT compiler.
    """
    if not columns:
        return df
    parsed = df.withColumn("_money", F.transform(F.transform(F.array(*columns), _bare), _parse_bare))
    return parsed.withColumns({c: F.get("_money", F.lit(i)) for i, c in enumerate(columns)}).drop("_money")


def money(c: Column | str | int | float) -> Column:
    return (col_of(c) if isinstance(c, (str, Column)) else F.lit(c)).cast(MONEY)


def money_out(c: Column | str) -> Column:
    """Output form: double, NULL as 0.0. Use it in the last projection only."""
    return F.coalesce(col_of(c), F.lit(0)).cast("double")


def fmt_money(c: Column | str) -> Column:
    """``$1,234.56``, ``-$1,234.56``; NULL is ``$0.00``."""
    value = F.coalesce(col_of(c).cast("decimal(38,2)"), F.lit(0).cast("decimal(38,2)"))
    return F.concat(F.when(value < 0, F.lit("-$")).otherwise(F.lit("$")), F.format_number(F.abs(value), 2))


def plain_money(c: Column | str) -> Column:
    """Two decimals without separators, as used in memo and fingerprint text."""
    return col_of(c).cast(MONEY).cast("string")


def memo_balance(c: Column | str) -> Column:
    return F.concat(F.lit("Balance: $"), plain_money(c))


def memo_mortgage(principal: Column | str, interest: Column | str) -> Column:
    return F.concat(
        F.lit("Principal: $"), plain_money(principal), F.lit(" | Interest: $"), plain_money(interest)
    )


def income_part(amount: Column | str) -> Column:
    """The amount where it is positive, else 0."""
    a = col_of(amount)
    return F.when(a > 0, a).otherwise(F.lit(0).cast(MONEY))


def expense_part(amount: Column | str) -> Column:
    """The absolute amount where it is negative, else 0."""
    a = col_of(amount)
    return F.when(a < 0, F.abs(a)).otherwise(F.lit(0).cast(MONEY))


def ratio_pct(part: Column, whole: Column) -> Column:
    """part / whole * 100 in double, 0.0 when the whole is 0 or NULL."""
    w = whole.cast("double")
    return F.when(F.coalesce(w, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(part.cast("double") / w * 100)
