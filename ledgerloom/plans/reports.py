"""Money reports.

Every report takes the tables it reads and an optional list ``by`` of extra
grouping columns of the transactions (a household, a tenant), so one run can serve
many ledgers. The fact table is aggregated on its own keys first (month, category
id), map-side, so at most one row per key and task is shuffled; names are joined
to the small result. Money sums stay DECIMAL and leave as double.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import days_between, month_key
from ledgerloom.functions.money import MONEY, expense_part, income_part, money_out, ratio_pct
from ledgerloom.operators.filters import (
    NOT_INCOME_OR_EXPENSE,
    PAGE_SIZE,
    between_dates,
    exclude_transfers,
    only_transfers,
    top_n,
)
from ledgerloom.operators.views import category_names, net_worth_parts
from ledgerloom.session import stored

Day = Column | dt.date

# Words that mark a category as tax related.
TAX_WORDS = ["tax", "donation", "charitable", "rrsp", "resp", "business", "tuition", "education"]

# Rows shown in charts, lists and bars.
TOP_CHART, TOP_LIST, TOP_BARS = 10, 12, 7


def _day(value: Day) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


# --- cash flow ---------------------------------------------------------------


def _cash_flow(txns: DataFrame, months: int, by: Sequence[str]) -> DataFrame:
    monthly = (
        exclude_transfers(txns)
        .groupBy(*by, month_key("date").alias("month"))
        .agg(F.sum(income_part("amount")).alias("income"), F.sum(expense_part("amount")).alias("expenses"))
    )
    return top_n(monthly, months, [F.col("month").desc()], by).withColumn("net", F.col("income") - F.col("expenses"))


def monthly_cash_flow(txns: DataFrame, months: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """Income and expenses of the last ``months`` months that have rows, oldest first."""
    flow = _cash_flow(txns, months, by)
    return flow.select(*by, "month", _out("income"), _out("expenses")).orderBy(*by, "month")


def income_expense_totals(txns: DataFrame, months: int = 12, by: Sequence[str] = ()) -> DataFrame:
    flow = _cash_flow(txns, months, by)
    return flow.groupBy(*by).agg(*[money_out(F.sum(c)).alias(c) for c in ("income", "expenses", "net")])


def _savings_rate() -> Column:
    income = F.col("income").cast("double")
    base = F.when(income == 0, F.lit(1.0)).otherwise(income)
    return F.bround(F.col("net").cast("double") / base * 100, 1)


def _savings(txns: DataFrame, months: int, by: Sequence[str]) -> DataFrame:
    # At most ``months`` rows per ledger reach the running total.
    so_far = Window.partitionBy(*by).orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _cash_flow(txns, months, by).withColumns(
        {"savings_rate": _savings_rate(), "cumulative": F.sum("net").over(so_far)}
    )


def savings_report(txns: DataFrame, months: int = 12, by: Sequence[str] = ()) -> DataFrame:
    table = _savings(txns, months, by)
    columns = [_out(c) for c in ("income", "expenses", "net")]
    return table.select(*by, "month", *columns, "savings_rate", _out("cumulative")).orderBy(*by, "month")


def savings_stats(txns: DataFrame, months: int = 12, by: Sequence[str] = ()) -> DataFrame:
    return (
        _savings(txns, months, by)
        .groupBy(*by)
        .agg(
            money_out(F.sum("net")).alias("total_saved"),
            (money_out(F.sum("net")) / F.count("net")).alias("avg_month"),
            (F.sum(F.col("savings_rate").cast("decimal(28,1)")).cast("double") / F.count("net")).alias("avg_rate"),
            F.max("savings_rate").alias("peak_rate"),
        )
    )


def monthly_summary(txns: DataFrame, months: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """Sums, mean net and the best month, the earliest one on ties."""
    flow = _cash_flow(txns, months, by)
    best = F.min_by("month", F.struct(-F.col("net"), F.col("month")))
    return flow.groupBy(*by).agg(
        money_out(F.sum("income")).alias("income"),
        money_out(F.sum("expenses")).alias("expenses"),
        (money_out(F.sum("net")) / F.count("net")).alias("avg_net"),
        best.alias("best_month"),
    )


def monthly_rates(txns: DataFrame, months: int = 12, by: Sequence[str] = ()) -> DataFrame:
    flow = _cash_flow(txns, months, by).withColumn("savings_rate", _savings_rate())
    columns = [_out(c) for c in ("income", "expenses", "net")]
    return flow.select(*by, "month", *columns, "savings_rate").orderBy(*by, "month")


# --- by category -------------------------------------------------------------


def _out(c: str) -> Column:
    return money_out(c).alias(c)


def category_totals(
    txns: DataFrame, children: DataFrame, parents: DataFrame, start: Day | None, end: Day | None, income: bool, by: Sequence[str]
) -> DataFrame:
    """Absolute sums per category and parent in DECIMAL, unordered."""
    part = F.col("amount") > 0 if income else F.col("amount") < 0
    per_id = (
        between_dates(exclude_transfers(txns), start, end)
        .filter(part & F.col("child_category_id").isNotNull())
        .groupBy(*by, "child_category_id")
        .agg(F.sum(F.abs("amount")).alias("total"))
    )
    names = category_names(children, parents).filter(F.col("parent_is_income") == int(income))
    return per_id.join(names, "child_category_id").groupBy(*by, "category", "parent_category").agg(F.sum("total").alias("total"))


def _ranked(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    order = [F.col("total").desc(), F.col("category")]
    return totals.orderBy(*by, *order).select(*by, "category", "parent_category", _out("total"))


def spending_by_category(
    txns: DataFrame, children: DataFrame, parents: DataFrame, start: Day | None = None, end: Day | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Absolute sum of negative amounts per category of the expense parents, largest first."""
    return _ranked(category_totals(txns, children, parents, start, end, False, by), by)


def income_by_category(
    txns: DataFrame, children: DataFrame, parents: DataFrame, start: Day | None = None, end: Day | None = None, by: Sequence[str] = ()
) -> DataFrame:
    return _ranked(category_totals(txns, children, parents, start, end, True, by), by)


def top_categories(
    txns: DataFrame, children: DataFrame, parents: DataFrame, start: Day, end: Day, k: int = TOP_CHART, by: Sequence[str] = ()
) -> DataFrame:
    totals = category_totals(txns, children, parents, start, end, False, by)
    best = top_n(totals, k, [F.col("total").desc(), F.col("category")], by)
    return best.select(*by, "category", "parent_category", _out("total"))


def category_monthly(
    txns: DataFrame, children: DataFrame, parents: DataFrame, start: Day | None = None, end: Day | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Signed sum per month and category."""
    totals = _monthly_totals(txns, children, parents, start, end, by)
    keys = ["month", "parent_category", "category"]
    return totals.select(*by, *keys, F.col("parent_is_income").alias("is_income"), _out("total")).orderBy(*by, *keys)


def _monthly_totals(
    txns: DataFrame, children: DataFrame, parents: DataFrame, start: Day | None, end: Day | None, by: Sequence[str]
) -> DataFrame:
    per_id = (
        between_dates(exclude_transfers(txns), start, end)
        .filter(F.col("child_category_id").isNotNull())
        .groupBy(*by, month_key("date").alias("month"), "child_category_id")
        .agg(F.sum("amount").alias("total"))
    )
    keys = [*by, "month", "parent_category", "category", "parent_is_income"]
    return per_id.join(category_names(children, parents), "child_category_id").groupBy(*keys).agg(F.sum("total").alias("total"))


def spending_by_parent(
    txns: DataFrame, children: DataFrame, parents: DataFrame, start: Day, end: Day, by: Sequence[str] = ()
) -> DataFrame:
    """Parent subtotals (category NULL) with their categories, parents by name."""
    totals = category_totals(txns, children, parents, start, end, False, by)
    rolled = totals.groupingSets(
        [[*[F.col(b) for b in by], F.col("parent_category"), F.col("category")], [*[F.col(b) for b in by], F.col("parent_category")]],
        *by, "parent_category", "category",
    ).agg(F.sum("total").alias("total"), F.grouping("category").alias("is_parent"))
    order = [*by, F.col("parent_category"), F.col("is_parent").desc(), F.col("total").desc(), F.col("category")]
    return rolled.orderBy(*order).select(*by, "parent_category", "category", "is_parent", _out("total"))


def category_month_long(
    txns: DataFrame, children: DataFrame, parents: DataFrame, start: Day, end: Day, by: Sequence[str] = ()
) -> DataFrame:
    """Per month: parent subtotals (category NULL) and their categories."""
    totals = _monthly_totals(txns, children, parents, start, end, by)
    fixed = [F.col(c) for c in [*by, "month", "parent_category"]]
    return totals.groupingSets([[*fixed, F.col("category")], fixed], *by, "month", "parent_category", "category").agg(
        F.sum("total").alias("total"), F.grouping("category").alias("is_parent")
    )


def category_month_pivot(
    txns: DataFrame, children: DataFrame, parents: DataFrame, start: Day, end: Day, by: Sequence[str] = ()
) -> DataFrame:
    """Rows: a parent's subtotal, then its categories; one column per month present, plus Total.

    The facts are read once: the sums per month and category are written, and give both
    the list of month names, which alone reaches the driver, and the cells. A month is
    present if any transaction of a category of the tree falls into it.
    """
    long = stored(category_month_long(txns, children, parents, start, end, by), "month-totals")
    months = [r["month"] for r in long.select("month").distinct().orderBy("month").collect()]
    wide = long.groupBy(*by, "parent_category", "category", "is_parent").pivot("month", months).agg(F.sum("total"))
    none = F.lit(0).cast("decimal(38,2)")
    filled = [F.coalesce(F.col(f"`{m}`"), none) for m in months]
    total = sum(filled[1:], filled[0]) if filled else none
    return wide.select(
        *by,
        "parent_category",
        "category",
        "is_parent",
        *[v.cast("double").alias(m) for v, m in zip(filled, months)],
        total.cast("double").alias("Total"),
    ).orderBy(*by, "parent_category", F.col("is_parent").desc(), "category")


def with_share(totals: DataFrame, by: Sequence[str] = (), value: str = "total") -> DataFrame:
    """Percent of the group's total, 0 when it is 0. The rows are one per category, not per transaction."""
    whole = F.sum(F.col(value).cast("decimal(38,2)")).over(Window.partitionBy(*by))
    return totals.withColumn("share", ratio_pct(F.col(value), whole))


def top_spending(
    txns: DataFrame, children: DataFrame, parents: DataFrame, start: Day, end: Day, n: int = TOP_BARS, by: Sequence[str] = ()
) -> DataFrame:
    """The n largest categories with their percent of the largest and a band."""
    best = top_categories(txns, children, parents, start, end, n, by)
    largest = F.max("total").over(Window.partitionBy(*by))
    pct = F.least(ratio_pct(F.col("total"), largest), F.lit(100.0))
    band = F.when(F.col("pct") > 80, "high").when(F.col("pct") > 50, "medium").otherwise("low")
    return best.withColumn("pct", pct).withColumn("band", band)


def _facts(totals: DataFrame, start: Day, end: Day, by: Sequence[str]) -> DataFrame:
    days = days_between(_day(start), _day(end))
    top = F.min_by("category", F.struct(-F.col("total"), F.col("category")))
    return totals.groupBy(*by).agg(
        money_out(F.sum("total")).alias("total"),
        top.alias("top_category"),
        F.count(F.lit(1)).alias("categories"),
        (money_out(F.sum("total")) / days).alias("avg_per_day"),
    )


def spending_facts(
    txns: DataFrame, children: DataFrame, parents: DataFrame, start: Day, end: Day, by: Sequence[str] = ()
) -> DataFrame:
    return _facts(category_totals(txns, children, parents, start, end, False, by), start, end, by)


def income_facts(
    txns: DataFrame, children: DataFrame, parents: DataFrame, start: Day, end: Day, by: Sequence[str] = ()
) -> DataFrame:
    return _facts(category_totals(txns, children, parents, start, end, True, by), start, end, by).drop("top_category")


def _names_any(words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.lower("category").contains(word)
    return hit


def tax_report(
    txns: DataFrame, children: DataFrame, parents: DataFrame, start: Day, end: Day,
    words: Sequence[str] = TAX_WORDS, by: Sequence[str] = (),
) -> DataFrame:
    """Tax related spending categories with their share of the tax related total."""
    taxed = with_share(category_totals(txns, children, parents, start, end, False, by).filter(_names_any(words)), by)
    order = [*by, F.col("total").desc(), F.col("category")]
    return taxed.orderBy(*order).select(*by, "category", "parent_category", _out("total"), "share")


def tax_totals(
    txns: DataFrame, children: DataFrame, parents: DataFrame, start: Day, end: Day,
    words: Sequence[str] = TAX_WORDS, by: Sequence[str] = (),
) -> DataFrame:
    """Income, tax related spending and its percent of income, from one pass over the period."""
    per_id = (
        between_dates(exclude_transfers(txns), start, end)
        .filter(F.col("child_category_id").isNotNull())
        .groupBy(*by, "child_category_id")
        .agg(F.sum(income_part("amount")).alias("income"), F.sum(expense_part("amount")).alias("spent"))
    )
    named = per_id.join(category_names(children, parents), "child_category_id")
    hit = _names_any(words)
    income = F.coalesce(F.sum(F.when(F.col("parent_is_income") == 1, F.col("income"))), F.lit(0).cast(MONEY))
    tax = F.coalesce(F.sum(F.when((F.col("parent_is_income") == 0) & hit, F.col("spent"))), F.lit(0).cast(MONEY))
    sums = named.groupBy(*by).agg(income.alias("income_total"), tax.alias("tax_total"))
    return sums.select(*by, _out("income_total"), _out("tax_total"), ratio_pct(F.col("tax_total"), F.col("income_total")).alias("deductible_rate"))


# --- period and lists --------------------------------------------------------


def period_kpis(
    txns: DataFrame, children: DataFrame, start: Day, end: Day,
    skip: Sequence[str] = NOT_INCOME_OR_EXPENSE, by: Sequence[str] = (),
) -> DataFrame:
    """Income, expenses, savings and savings rate; uncategorised rows count."""
    per_id = (
        between_dates(exclude_transfers(txns), start, end)
        .groupBy(*by, "child_category_id")
        .agg(F.sum(income_part("amount")).alias("income"), F.sum(expense_part("amount")).alias("expenses"))
    )
    left_out = children.filter(F.col("name").isin(list(skip))).select(F.col("id").alias("child_category_id"))
    zero = F.lit(0).cast(MONEY)
    sums = (
        per_id.join(left_out, "child_category_id", "left_anti")
        .groupBy(*by)
        .agg(F.coalesce(F.sum("income"), zero).alias("income"), F.coalesce(F.sum("expenses"), zero).alias("expenses"))
        .withColumn("savings", F.col("income") - F.col("expenses"))
    )
    rate = ratio_pct(F.col("savings"), F.col("income")).alias("savings_rate")
    return sums.select(*by, _out("income"), _out("expenses"), _out("savings"), rate)


def list_summary(rows: DataFrame, size: int = PAGE_SIZE, by: Sequence[str] = ()) -> DataFrame:
    """Count, income, expenses and number of pages of a filtered list, or of each list by the columns ``by``, in one pass."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        money_out(F.sum(income_part("amount"))).alias("income"),
        money_out(F.sum(expense_part("amount"))).alias("expenses"),
    ).withColumn("pages", F.greatest(F.ceil(F.col("row_count") / size), F.lit(1)).cast("bigint"))


def running_net(txns: DataFrame, months: int = 12, by: Sequence[str] = ()) -> DataFrame:
    return _savings(txns, months, by).select(*by, "month", _out("net"), _out("cumulative")).orderBy(*by, "month")


# --- accounts, categories, counts ---------------------------------------------


def accounts_listing(accounts: DataFrame) -> DataFrame:
    return accounts.withColumn("balance", money_out("balance")).orderBy("type", "name")


def accounts_by_type(accounts: DataFrame) -> DataFrame:
    return (
        accounts.groupBy("type")
        .agg(F.count(F.lit(1)).alias("accounts"), money_out(F.sum("balance")).alias("balance"))
        .orderBy("type")
    )


def net_worth(accounts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Assets, liabilities and their difference, per value of ``by``; overdrawn asset accounts do not count."""
    parts = net_worth_parts(accounts, by)
    zero = F.lit(0).cast(MONEY)
    sums = parts.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "asset", F.col("value"))), zero).alias("assets"),
        F.coalesce(F.sum(F.when(F.col("kind") == "liability", -F.col("value"))), zero).alias("liabilities"),
    )
    net = money_out(F.col("assets") - F.col("liabilities")).alias("net_worth")
    return sums.select(*by, _out("assets"), _out("liabilities"), net)


def category_sizes(children: DataFrame, parents: DataFrame) -> DataFrame:
    per_parent = children.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    sized = parents.join(per_parent, "id", "left")
    return sized.select("name", "is_income", F.coalesce("n", F.lit(0)).alias("children")).orderBy("name")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count."""
    counts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


def contributions_by_category(
    txns: DataFrame, accounts: DataFrame, start: Day | None = None, end: Day | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Absolute sum of transfers per investment category, else destination account, else "General".

    Sums per category text and destination id come first; account names join that small result.
    """
    keys = [*by, "transfer_investment_cat", "transfer_to_account_id"]
    sums = between_dates(only_transfers(txns), start, end).groupBy(*keys).agg(F.sum(F.abs("amount")).alias("total"))
    names = accounts.select(F.col("id").alias("transfer_to_account_id"), F.col("name").alias("to_account"))
    label = F.coalesce(F.nullif("transfer_investment_cat", F.lit("")), F.nullif("to_account", F.lit("")), F.lit("General"))
    named = sums.join(names, "transfer_to_account_id", "left")
    return named.groupBy(*by, label.alias("category")).agg(money_out(F.sum("total")).alias("total"))


# --- splits and imports --------------------------------------------------------


def split_balance(txns: DataFrame, splits: DataFrame) -> DataFrame:
    """Allocated sum of split lines against the transaction, valid within one cent."""
    per_txn = splits.groupBy(F.col("transaction_id").alias("id")).agg(F.sum("amount").alias("allocated"))
    joined = txns.select("id", "amount").join(per_txn, "id")
    left = (F.col("amount") - F.col("allocated")).cast("decimal(38,2)")
    return joined.select(
        F.col("id").alias("transaction_id"),
        money_out("amount").alias("total"),
        _out("allocated"),
        money_out(left).alias("leftover"),
        F.when(F.abs(left) <= 0.01, 1).otherwise(0).alias("valid"),
    )


def split_shares(lines: DataFrame) -> DataFrame:
    """Percent of each split line within its transaction; a zero sum divides by 1.

    The sum is a map-side aggregate joined back, so a transaction with very many
    lines does not become one window partition.
    """
    sums = lines.groupBy("transaction_id").agg(F.sum(F.abs("amount")).cast("double").alias("_sum"))
    base = F.when(F.col("_sum") == 0, F.lit(1.0)).otherwise(F.col("_sum"))
    share = F.abs("amount").cast("double") / base * 100
    return lines.join(sums, "transaction_id").withColumn("share", share).drop("_sum")


def import_summary(batch: DataFrame, added: DataFrame, rejected: DataFrame) -> DataFrame:
    """Per file and for all files: rows parsed, inserted, skipped and rejected.

    Each frame is counted per file map-side; rows are never matched with each other.
    """
    def count(df: DataFrame, name: str) -> DataFrame:
        zeros = {c: F.lit(0).cast("bigint") for c in ("parsed", "inserted", "rejected")}
        counted = df.groupBy("source_file").agg(F.count(F.lit(1)).alias("_n"))
        return counted.select("source_file", *[(F.col("_n") if c == name else z).alias(c) for c, z in zeros.items()])

    parts = count(batch, "parsed").unionByName(count(added, "inserted")).unionByName(count(rejected, "rejected"))
    sums = parts.rollup("source_file").agg(
        F.grouping("source_file").alias("_all"), *[F.sum(c).alias(c) for c in ("parsed", "inserted", "rejected")]
    )
    return sums.select(
        F.when(F.col("_all") == 1, "ALL FILES").otherwise(F.col("source_file")).alias("source_file"),
        "parsed",
        "inserted",
        (F.col("parsed") - F.col("inserted")).alias("skipped"),
        "rejected",
    )
