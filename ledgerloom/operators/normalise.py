"""Statement rows of five layouts to one transaction schema.

A layout is a header specification and a function from role columns to output
columns. Everything is a column expression chosen on the driver from the file's
header; the data is read once and nothing is shuffled except the one row per file
that carries a detected account number.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import parse_date
from ledgerloom.functions.money import MONEY, clean_amounts, memo_balance, memo_mortgage
from ledgerloom.functions.text import account_label, account_ref, fingerprint
from ledgerloom.session import stored
from ledgerloom.sources.statements import BAD, LINEAGE, Holding, Named, resolve_columns, statement_columns

Roles = Mapping[str, str | None]

# Action code -> category.
ACTION_CATEGORIES = {
    "BUY": "Stocks", "TFI": "Stocks", "SELL": "Stocks", "TFO": "Stocks",
    "DEP": "Transfer", "CSH": "Transfer", "EFT": "Transfer", "CON": "Transfer",
    "DIV": "Dividends", "INT": "Interest Income", "FEE": "Bank Fees", "MNG": "Bank Fees",
}

# Part of the type text -> category, tried in this order.
TYPE_CATEGORIES = [
    ("buy", "ETFs"), ("purchase", "ETFs"), ("sell", "ETFs"), ("dividend", "Dividends"),
    ("contribution", "Transfer"), ("deposit", "Transfer"), ("withdrawal", "Transfer"),
    ("fee", "Bank Fees"), ("interest", "Interest Income"),
]
OTHER_INVESTMENT = "Investments"
MORTGAGE_CATEGORY, MORTGAGE_TEXT = "Mortgage", "Mortgage Payment"

# Parts of a header that marks an account or card number column.
ACCOUNT_HEADERS = ["account#", "accountno", "accountnumber", "cardnumber", "card#", "maskedcard"]

OUTPUT_COLUMNS = [
    "account_label", "account_number", "date", "description", "original_desc", "amount", "category", "memo",
    "currency", "hash",
]


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def _no_text() -> Column:
    return F.lit(None).cast("string")


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


# Roles that hold amounts. They are parsed once, before the layouts combine them.
MONEY_ROLES = ["outflow", "inflow", "amount", "balance", "net", "gross", "principal", "interest", "payment", "total_payment"]


def in_minus_out(inflow: Column, outflow: Column) -> Column:
    """Inflow minus outflow when there is an inflow, else minus the outflow; NULL if too wide, so the row is set aside."""
    return F.when(inflow != 0, inflow - outflow).otherwise(-outflow).try_cast(MONEY)


def action_category(action: Column) -> Column:
    code = F.upper(action)
    chain = F.lit(OTHER_INVESTMENT)
    by_category: dict[str, list[str]] = {}
    for key, category in ACTION_CATEGORIES.items():
        by_category.setdefault(category, []).append(key)
    for category, codes in by_category.items():
        chain = F.when(code.isin(codes), category).otherwise(chain)
    return chain


def type_category(kind: Column) -> Column:
    low = F.lower(kind)
    (first, category), *rest = TYPE_CATEGORIES
    chain = F.when(low.contains(first), category)
    for part, category in rest:
        chain = chain.when(low.contains(part), category)
    return chain.otherwise(OTHER_INVESTMENT)


def _balance_memo(roles: Roles) -> Column:
    return memo_balance("balance") if roles["balance"] else _no_text()


def _cash(roles: Roles) -> dict[str, Column]:
    if roles["outflow"]:
        amount = in_minus_out(F.col("inflow"), F.col("outflow"))
    else:
        amount = F.col("amount")
    text = _text("description")
    return {
        "description": text, "original_desc": text, "amount": amount, "category": _no_text(),
        "memo": _balance_memo(roles), "currency": F.lit("CAD"),
    }


def _card(roles: Roles) -> dict[str, Column]:
    size = F.abs("amount")
    incoming = F.lower(F.coalesce("kind", F.lit(""))).rlike("payment|credit")
    text = _text("description")
    return {
        "description": text, "original_desc": text, "amount": F.when(incoming, size).otherwise(-size).cast(MONEY),
        "category": _no_text(), "memo": _no_text(), "currency": F.lit("CAD"),
    }


def _brokerage(roles: Roles) -> dict[str, Column]:
    action, symbol, text = _text("action"), _text("symbol"), _text("description")
    named = F.concat_ws(" - ", F.concat_ws(" ", action, symbol), F.nullif(text, F.lit("")))
    return {
        "description": F.when(symbol != "", named).when(text != "", text).otherwise(action),
        "original_desc": text,
        "amount": F.col("net" if roles["net"] else "gross"),
        "category": action_category(action),
        "memo": _no_text(),
        "currency": F.trim(F.coalesce("currency", F.lit("CAD"))),
    }


def _invest(roles: Roles) -> dict[str, Column]:
    kind, symbol, text = _text("kind"), _text("symbol"), _text("description")
    return {
        "description": F.when(symbol != "", F.concat(kind, F.lit(": "), symbol)).when(text != "", text).otherwise(kind),
        "original_desc": text,
        "amount": F.col("net"),
        "category": type_category(kind),
        "memo": _no_text(),
        "currency": F.trim(F.coalesce("currency", F.lit("CAD"))),
    }


def _mortgage(roles: Roles) -> dict[str, Column]:
    if roles["has_principal"]:
        principal, interest = F.col("principal"), F.col("interest")
        total = principal + interest
        # A payment column that is present decides, unless it holds a zero.
        for role in ("payment", "total_payment"):
            if roles[role]:
                paid = F.col(role)
                total = F.when(~F.col(f"{role}_given") | (paid != 0), paid).otherwise(total)
        amount, memo = -F.abs(total), memo_mortgage(principal, interest)
    else:
        amount, memo = in_minus_out(F.col("inflow"), F.col("outflow")), _balance_memo(roles)
    text = F.trim(F.coalesce(F.col("description"), F.lit(MORTGAGE_TEXT)))
    return {
        "description": text, "original_desc": text, "amount": amount.try_cast(MONEY),
        "category": F.lit(MORTGAGE_CATEGORY), "memo": memo, "currency": F.lit("CAD"),
    }


@dataclass(frozen=True)
class Layout:
    bank: str
    account_type: str
    spec: Mapping[str, Named | Holding]
    build: Callable[[Roles], dict[str, Column]]
    any_account_column: bool = False


_OUTFLOW = Holding(("withdrawal", "debit"))
_INFLOW = Holding(("deposit", "credit"))
_BALANCE = Holding(("balance",))

# Institution -> bank name, account type and header names of its statements.
LAYOUTS = {
    "Wealthsimple Cash": Layout(
        "Wealthsimple", "checking",
        {
            "date": Named(("Date", "Transaction Date")),
            "description": Named(("Description", "Merchant Name")),
            "outflow": _OUTFLOW, "inflow": _INFLOW, "amount": Holding(("amount",)), "balance": _BALANCE,
        },
        _cash,
    ),
    "Rogers Mastercard": Layout(
        "Rogers Bank", "credit",
        {
            "date": Holding(("transaction date",), "date"),
            "description": Named(("Description", "Merchant Name")),
            "amount": Holding(("amount",)), "kind": Named(("Type",)),
        },
        _card,
    ),
    "Questrade": Layout(
        "Questrade", "investment",
        {
            "date": Named(("Transaction Date", "Activity Date")),
            "action": Named(("Action", "Activity Type")),
            "symbol": Named(("Symbol",)), "description": Named(("Description",)),
            "net": Holding(("net amount",), "net"), "gross": Holding(("gross",)), "currency": Named(("Currency",)),
        },
        _brokerage,
        any_account_column=True,
    ),
    "Wealthsimple Invest": Layout(
        "Wealthsimple", "investment",
        {
            "date": Named(("Date", "Activity Date", "Transaction Date")),
            "kind": Named(("Type", "Activity Type")), "symbol": Named(("Symbol", "Security")),
            "description": Named(("Description",)), "net": Holding(("net", "amount")), "currency": Named(("Currency",)),
        },
        _invest,
    ),
    "CIBC Mortgage": Layout(
        "CIBC", "mortgage",
        {
            "date": Named(("Date", "Transaction Date")),
            "description": Named(("Description", "Activity")),
            "has_principal": Holding(("principal",)), "principal": Named(("Principal",)), "interest": Named(("Interest",)),
            "total_payment": Named(("Total Payment",)), "payment": Named(("Payment",)),
            "outflow": Holding(("debit", "withdrawal")), "inflow": Holding(("credit", "deposit")), "balance": _BALANCE,
        },
        _mortgage,
    ),
}


def layout_of(institution: str) -> Layout:
    if institution not in LAYOUTS:
        raise ValueError(f"unknown institution: {institution}")
    return LAYOUTS[institution]


def institutions(df: DataFrame, name: str = "institution") -> DataFrame:
    """Adds bank and account_type of an institution name, NULL where it is unknown."""
    pick = {"bank": lambda l: l.bank, "account_type": lambda l: l.account_type}
    for column, get in pick.items():
        chain = _no_text()
        for institution, layout in LAYOUTS.items():
            chain = F.when(F.col(name) == institution, get(layout)).otherwise(chain)
        df = df.withColumn(column, chain)
    return df


# --- account numbers -----------------------------------------------------------


def _last4(digits: Column) -> Column:
    return F.concat(F.lit("****"), F.substring(digits, -4, 4))


def _from_account_column(value: Column) -> Column:
    kept = F.regexp_replace(value, "[^0-9Xx*]", "")
    return F.when(F.length(kept) >= 4, _last4(kept))


def _from_cell(value: Column) -> Column:
    card = F.regexp_extract(value, r"\b(\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4})\b", 1)
    run = F.regexp_extract(value, r"\b\d{10,}\b", 0)
    return F.when(card != "", _last4(F.regexp_replace(card, r"\D", ""))).when(run != "", _last4(run))


def _looks_like_number(value: Column) -> Column:
    return (F.length(value) >= 10) & value.rlike(r"\b(\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}|\d{10,})\b")


def _account_columns(columns: list[str]) -> list[str]:
    def marks(name: str) -> bool:
        bare = name.lower().replace(" ", "").replace("_", "")
        return any(h in bare for h in ACCOUNT_HEADERS)

    return [c for c in columns if marks(c)]


def detect_account(df: DataFrame, hint: str = "", any_account_column: bool = False) -> DataFrame:
    """(source_file, account_number) per file, masked to the last four digits, NULL if none is found.

    In order: the first value of a column named like an account number; a card number
    or a run of ten or more digits among the first three cells of each column; four
    or more digits of ``hint``. ``any_account_column`` adds, last, the digits of the
    first value of any column with "account" in its name.

    Two scans with hash aggregates, no sort. The first finds, per file and column, the
    position of the first value (account columns) and of the first cell that looks
    like a number; that is written, so the second meets a table of known size and moves no rows where it is small. The second, only for files that have one, counts the cells before
    that position and fetches the text. At most one row per file and task is shuffled,
    so it does not matter how many rows a file has.
    """
    columns = statement_columns(df)
    marked = _account_columns(columns)
    general = [c for c in columns if "account" in c.lower()][:1] if any_account_column else []
    named = list(dict.fromkeys([*marked, *general]))

    # One decimal is an order that a hash aggregate can keep; a struct is not.
    position = (F.col("source_block").cast("decimal(18,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") + F.col("source_row")).cast("decimal(38,0)")
    placed = df.select("source_file", position.alias("_at"), F.array(*[F.col(f"`{c}`") for c in columns]).alias("_cells"))
    flagged = placed.withColumn("_hits", F.transform("_cells", _looks_like_number))

    def cell(c: str) -> Column:
        return F.get("_cells", F.lit(columns.index(c)))

    firsts = [F.min(F.when(cell(c).isNotNull(), F.col("_at"))).alias(f"_first_{i}") for i, c in enumerate(named)]
    hits = [F.min(F.when(F.get("_hits", F.lit(i)), F.col("_at"))).alias(f"_hit_{i}") for i in range(len(columns))]
    marks = stored(flagged.groupBy("source_file").agg(*firsts, *hits), "file-marks")

    found = F.array(*[F.col(f"_hit_{i}") for i in range(len(columns))])
    starts = F.array(F.lit(None).cast("decimal(38,0)"), *[F.col(f"_first_{i}") for i in range(len(named))])
    some = marks.withColumn("_until", F.array_max(found)).withColumn("_starts", starts).filter(
        F.col("_until").isNotNull() | F.array_max("_starts").isNotNull()
    )
    at = F.col("_at")
    near = placed.join(some, "source_file").filter(
        F.coalesce(at <= F.col("_until"), F.lit(False)) | F.coalesce(F.array_contains("_starts", at), F.lit(False))
    )
    values = [F.max(F.when(at == F.col(f"_first_{i}"), cell(c))).alias(f"_value_{i}") for i, c in enumerate(named)]
    before, masks = [], []
    for i in range(len(columns)):
        text, hit = F.get("_cells", F.lit(i)), F.col(f"_hit_{i}")
        before.append(F.count(F.when(text.isNotNull() & (at < hit), 1)).alias(f"_before_{i}"))
        masks.append(F.max(F.when(at == hit, _from_cell(text))).alias(f"_mask_{i}"))
    seen = near.groupBy("source_file").agg(*values, *before, *masks)

    by_name = [_from_account_column(F.col(f"_value_{named.index(c)}")) for c in marked]
    by_cell = [F.when(F.col(f"_before_{i}") < 3, F.col(f"_mask_{i}")) for i in range(len(columns))]
    hinted = F.regexp_extract(F.lit(hint), r"\d{4,}", 0)
    last = []
    for c in general:
        digits = F.regexp_replace(F.col(f"_value_{named.index(c)}"), r"\D", "")
        tail = F.when(F.length(digits) > 4, F.substring(digits, -4, 4)).otherwise(digits)
        last.append(F.when(digits != "", F.concat(F.lit("****"), tail)))
    masked = F.coalesce(*by_name, *by_cell, F.when(hinted != "", _last4(hinted)), *last)
    return marks.select("source_file").join(seen, "source_file", "left").select("source_file", masked.alias("account_number"))


# --- normalised rows -----------------------------------------------------------


# All cells of a statement row, kept so that accounts are found and rejects repaired without a second parse.
CELLS = "cells"


def parsed_rows(df: DataFrame, layout: Layout) -> DataFrame:
    """Every row: LINEAGE, CELLS, BAD, date_raw, date and the layout's output columns; no account yet."""
    bad = F.col(BAD) if BAD in df.columns else F.lit(None).cast("string")
    cells = F.array(*[F.col(f"`{c}`") for c in statement_columns(df)])
    rows, roles = resolve_columns(df, layout.spec, {CELLS: cells, BAD: bad})
    return _built(rows, roles, layout, [CELLS, BAD])


def cells_of(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The statement's cells under their column names again, from ``parsed_rows``; BAD rows are left out."""
    whole = rows.filter(F.col(BAD).isNull())
    return whole.select(*LINEAGE, *[F.get(CELLS, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def normalise_rows(df: DataFrame, layout: Layout) -> DataFrame:
    """Role columns to LINEAGE, date_raw, date and the layout's output columns; no account yet. Rows without a date cell go."""
    rows, roles = resolve_columns(df.filter(F.col(BAD).isNull()) if BAD in df.columns else df, layout.spec)
    return _built(rows.filter(F.col("date").isNotNull()), roles, layout, [])


def _built(rows: DataFrame, roles: Roles, layout: Layout, keep: list[str]) -> DataFrame:
    money = [r for r in MONEY_ROLES if roles.get(r)]
    absent = {r: _zero() for r in MONEY_ROLES if r in roles and not roles[r]}
    given = {f"{r}_given": F.col(r).isNotNull() for r in ("payment", "total_payment") if r in roles}
    rows = clean_amounts(rows.withColumns(given), money).withColumns(absent)
    built = layout.build(roles)
    lineage = [c for c in LINEAGE if c in rows.columns]
    return rows.select(
        *lineage,
        *keep,
        F.col("date").alias("date_raw"),
        parse_date("date").alias("date"),
        *[c.alias(name) for name, c in built.items()],
    )


def with_fingerprint(rows: DataFrame, float_amounts: bool = False) -> DataFrame:
    """Adds ``hash``; with ``float_amounts`` that of ledgers whose fingerprints hold float texts."""
    ref = account_ref("account_label", "account_number")
    return rows.withColumn("hash", fingerprint(ref, "date", "description", "amount", float_amounts))


def file_accounts(
    df: DataFrame, institution: str, account_number: str | None = None, account_name: str | None = None
) -> DataFrame:
    """One row per file: source_file, institution, account_label, account_number.

    Without ``account_number`` it is detected. The label is ``account_name``, else
    institution and number.
    """
    if account_number is not None:
        files = df.select("source_file").distinct().withColumn("account_number", F.lit(account_number))
    else:
        files = detect_account(df, any_account_column=layout_of(institution).any_account_column)
    label = F.lit(account_name) if account_name is not None else account_label(F.lit(institution), "account_number")
    return files.select("source_file", F.lit(institution).alias("institution"), label.alias("account_label"), "account_number")


def normalise_statement(
    df: DataFrame, institution: str, account_number: str | None = None, account_name: str | None = None,
    files: DataFrame | None = None,
) -> DataFrame:
    """One transaction row per statement row that has a date cell.

    ``files`` are the file_accounts rows where they are known already. Rows still hold
    date_raw, so ``split_rejects`` can put unreadable ones aside. With a given number
    nothing is joined; else the one row per file is, from a written table, so that few files are sent to the rows.
    """
    rows = normalise_rows(df, layout_of(institution))
    if files is None and account_number is not None:
        label = F.lit(account_name) if account_name is not None else account_label(F.lit(institution), F.lit(account_number))
        fixed = {"institution": F.lit(institution), "account_label": label, "account_number": F.lit(account_number)}
        return with_fingerprint(rows.withColumns(fixed))
    if files is None:
        files = stored(file_accounts(df, institution, account_number, account_name), "files")
    return with_fingerprint(rows.join(files, "source_file"))


def split_rejects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a readable date and amount, the others)."""
    readable = F.col("date").isNotNull() & F.col("amount").isNotNull()
    return rows.filter(readable), rows.filter(~readable)
