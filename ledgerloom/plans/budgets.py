"""Budgets as an effective-dated series, goals and investments."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import month_start, previous_month
from ledgerloom.functions.money import MONEY, money_out, ratio_pct
from ledgerloom.functions.text import clip
from ledgerloom.operators.numbering import assign_ids
from ledgerloom.operators.views import category_ids, transfer_rows
from ledgerloom.plans.reports import category_totals

Month = str | dt.date


def _defaults(budgets: DataFrame) -> DataFrame:
    """carry_forward and carry_forward_type with their defaults."""
    flag = F.coalesce("carry_forward", F.lit(0)) if "carry_forward" in budgets.columns else F.lit(0)
    return budgets.withColumns(
        {"carry_forward": flag, "carry_forward_type": F.coalesce("carry_forward_type", F.lit("none"))}
    )


def budgets_asof(budgets: DataFrame, children: DataFrame, month: Month | Column, by: Sequence[str] = ()) -> DataFrame:
    """Per category, and value of ``by``, the budget row with the latest month at or before the asked one.

    A filter and one map-side aggregate; no self join.
    """
    asked = month if isinstance(month, Column) else month_start(month)
    row = F.struct("id", "month_year", "amount", "carry_forward", "carry_forward_type")
    latest = (
        _defaults(budgets)
        .filter(F.col("month_year") <= asked)
        .groupBy(*by, "child_category_id")
        .agg(F.max_by(row, "month_year").alias("b"))
        .select(*by, "child_category_id", "b.*")
    )
    names = children.select(F.col("id").alias("child_category_id"), F.col("name").alias("category"))
    return latest.join(names, "child_category_id")


def budgets_asof_months(budgets: DataFrame, children: DataFrame, months: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same for many months: ``months`` has one column, ``month`` (first days); for each of the columns ``by``.

    Each budget row is in force until the next one of its category. It is spread over
    the asked range of months and joined with the asked months on equality, so there
    is no inequality join.
    """
    by_category = Window.partitionBy(*by, "child_category_id").orderBy("month_year")
    span = months.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    low, high = span.select("lo").scalar(), span.select("hi").scalar()
    in_force = (
        _defaults(budgets)
        .withColumn("until", F.coalesce(F.add_months(F.lead("month_year").over(by_category), -1), high))
        .withColumn("since", F.greatest("month_year", low))
        .withColumn("until", F.least("until", high))
        .filter(F.col("since") <= F.col("until"))
    )
    monthly = in_force.withColumn("month", F.explode(F.sequence("since", "until", F.expr("interval 1 month"))))
    names = children.select(F.col("id").alias("child_category_id"), F.col("name").alias("category"))
    return (
        monthly.join(months.select("month").distinct(), "month")
        .join(names, "child_category_id")
        .select(*by, "month", "child_category_id", "category", "id", "month_year", "amount", "carry_forward", "carry_forward_type")
    )


def _month_spending(
    txns: DataFrame, children: DataFrame, parents: DataFrame, first: Column, by: Sequence[str] = ()
) -> DataFrame:
    sums = category_totals(txns, children, parents, first, F.last_day(first), False, by)
    return sums.groupBy(*by, "category").agg(F.sum("total").cast("decimal(38,2)").alias("spent"))


def budget_effective(
    budgets: DataFrame, txns: DataFrame, children: DataFrame, parents: DataFrame, month: Month
) -> DataFrame:
    """Budget of a month with carry-forward from the month before.

    The difference is the previous base minus the previous spending: "underspent"
    adds it when positive, "overspent" when negative, "both" always. The previous
    base carries nothing itself. Categories without a budget get 0.
    """
    first = month_start(month)
    before = previous_month(first)
    zero = F.lit(0).cast("decimal(38,2)")
    base = budgets_asof(budgets, children, first).select(
        "child_category_id", F.col("amount").alias("base"), "carry_forward_type"
    )
    previous = budgets_asof(budgets, children, before).select("child_category_id", F.col("amount").alias("previous_base"))
    spent = _month_spending(txns, children, parents, before)
    delta = F.coalesce("previous_base", zero) - F.coalesce("spent", zero)
    kind = F.coalesce("carry_forward_type", F.lit("none"))
    carry = (
        F.when((kind == "underspent") & (delta > 0), delta)
        .when((kind == "overspent") & (delta < 0), delta)
        .when(kind == "both", delta)
        .otherwise(zero)
    )
    return (
        children.select(F.col("id").alias("child_category_id"), F.col("name").alias("category"))
        .join(base, "child_category_id", "left")
        .join(previous, "child_category_id", "left")
        .join(spent, "category", "left")
        .select(
            "category",
            kind.alias("carry_forward_type"),
            money_out("base").alias("base"),
            money_out(F.when(F.col("base").isNull(), zero).otherwise(F.col("base") + carry)).alias("effective"),
        )
    )


def _performance(
    budgets: DataFrame, txns: DataFrame, children: DataFrame, parents: DataFrame, month: Month, by: Sequence[str] = ()
) -> DataFrame:
    """Expense categories with a budget or spending in the month, NULL for what there isn't; per value of ``by``."""
    first = month_start(month)
    budget = budgets_asof(budgets, children, first, by).select(
        *by, "child_category_id", F.col("amount").alias("budget"), "carry_forward_type"
    )
    spent = _month_spending(txns, children, parents, first, by)
    expense = children.filter(F.coalesce("is_income", F.lit(0)) == 0).select(
        F.col("id").alias("child_category_id"), F.col("name").alias("category")
    )
    keys = [*by, "child_category_id", "category"]
    return budget.join(expense, "child_category_id").join(spent.join(expense, "category"), keys, "full")


def budget_performance(
    budgets: DataFrame, txns: DataFrame, children: DataFrame, parents: DataFrame, month: Month, by: Sequence[str] = ()
) -> DataFrame:
    """Expense categories with a budget or spending: percent used, rest and band.

    ``by`` names columns of both budgets and transactions, a household for instance.
    """
    rows = _performance(budgets, txns, children, parents, month, by)
    zero = F.lit(0).cast("decimal(38,2)")
    rows = rows.withColumns({"budgeted": F.coalesce("budget", zero), "spent": F.coalesce("spent", zero)})
    pct = F.when(F.col("budgeted") == 0, F.lit(100.0)).otherwise(ratio_pct(F.col("spent"), F.col("budgeted")))
    band = F.when(F.col("pct") > 100, "over").when(F.col("pct") > 75, "near").otherwise("ok")
    return (
        rows.filter((F.col("budgeted") > 0) | (F.col("spent") > 0))
        .withColumn("pct", pct)
        .select(
            *by,
            "category",
            F.coalesce("carry_forward_type", F.lit("none")).alias("carry_forward_type"),
            money_out("budgeted").alias("budgeted"),
            money_out("spent").alias("spent"),
            money_out(F.col("budgeted") - F.col("spent")).alias("remaining"),
            "pct",
            band.alias("band"),
        )
        .orderBy(*by, F.col("pct").desc(), "category")
    )


def budget_totals(
    budgets: DataFrame, txns: DataFrame, children: DataFrame, parents: DataFrame, month: Month, by: Sequence[str] = ()
) -> DataFrame:
    """All budgets, the spending of budgeted expense categories, and what remains, for each of the columns ``by``."""
    zero = F.lit(0).cast("decimal(38,2)")
    budgeted = budgets_asof(budgets, children, month, by).select(*by, F.col("amount").cast("decimal(38,2)").alias("budgeted"), zero.alias("spent"))
    rows = _performance(budgets, txns, children, parents, month, by).filter(F.col("budget").isNotNull())
    parts = budgeted.unionAll(rows.select(*by, zero, F.col("spent").cast("decimal(38,2)")))
    sums = parts.groupBy(*by).agg(*(F.coalesce(F.sum(c), zero).cast("decimal(38,2)").alias(c) for c in ("budgeted", "spent")))
    return sums.select(
        *by,
        money_out("budgeted").alias("budgeted"),
        money_out("spent").alias("spent"),
        money_out(F.col("budgeted") - F.col("spent")).alias("remaining"),
    )


def unbudgeted_spend(
    budgets: DataFrame, txns: DataFrame, children: DataFrame, parents: DataFrame, month: Month, by: Sequence[str] = ()
) -> DataFrame:
    rows = _performance(budgets, txns, children, parents, month, by)
    return rows.filter(F.col("budget").isNull() & (F.col("spent") > 0)).select(
        *by, "category", money_out("spent").alias("spent")
    )


def upsert_budgets(budgets: DataFrame, updates: DataFrame, children: DataFrame) -> DataFrame:
    """The budget table after updates(category, month or effective_date, amount, seq[, carry_forward, carry_forward_type]).

    The key is (category, first of month); an effective date overrides the month and
    an unknown category is ignored. Of several updates of a key the one with the highest
    ``seq`` holds. A replaced row keeps its id.
    """
    if "seq" not in updates.columns:
        raise ValueError("updates need a column seq, their order per category and month")
    month = F.trunc(F.col("month"), "MM").cast("date")
    if "effective_date" in updates.columns:
        month = F.coalesce(F.trunc("effective_date", "MM").cast("date"), month)
    flag = F.col("carry_forward") if "carry_forward" in updates.columns else F.lit(0)
    kind = F.col("carry_forward_type") if "carry_forward_type" in updates.columns else F.lit("none")
    keys = ["child_category_id", "month_year"]
    row = F.struct(
        F.col("amount").cast(MONEY).alias("amount"),
        F.coalesce(flag, F.lit(0)).alias("carry_forward"),
        F.coalesce(kind, F.lit("none")).alias("carry_forward_type"),
    )
    named = updates.join(category_ids(children), "category").withColumn("month_year", month)
    new = named.groupBy(*keys).agg(F.max_by(row, "seq").alias("r")).select(*keys, "r.*")
    current = _defaults(budgets)
    kept = current.join(new.select(*keys), keys, "left_anti")
    replaced = new.join(current.select(*keys, "id"), keys)
    added = assign_ids(new.join(current.select(*keys), keys, "left_anti"), keys, budgets.agg(F.max("id")))
    columns = ["id", *keys, "amount", "carry_forward", "carry_forward_type"]
    return kept.select(columns).unionByName(replaced.select(columns)).unionByName(added.select(columns))


def copy_budgets(budgets: DataFrame, children: DataFrame, month: Month) -> DataFrame:
    """The budget table after copying last month's amounts to ``month``; carry-forward resets to none.

    Names are looked up again, so of equal names the budget of the smallest category id is copied.
    """
    first = month_start(month)
    last = budgets_asof(budgets, children, previous_month(first))
    named = last.groupBy("category").agg(F.min_by("amount", "child_category_id").alias("amount"))
    updates = named.select("category", first.alias("month"), "amount", F.lit(0).alias("seq"))
    return upsert_budgets(budgets, updates, children)


def goal_progress(goals: DataFrame, accounts: DataFrame) -> DataFrame:
    """Progress of monthly goals against the target and of total goals from the linked balance."""
    zero = F.lit(0).cast(MONEY)
    linked = accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"), "balance")
    rows = goals.join(linked, "account_id", "left").withColumn(
        "saved", F.greatest(F.coalesce("balance", zero), zero)
    )
    done = F.when(F.col("goal_type") == "monthly", F.coalesce("monthly_amount", zero)).otherwise(F.col("saved"))
    pct = F.least(ratio_pct(done, F.col("target_amount")), F.lit(100.0))
    band = F.when(F.col("pct") >= 100, "reached").when(F.col("pct") >= 50, "half").otherwise("started")
    return (
        rows.withColumn("pct", pct)
        .withColumn("band", band)
        .select(
            "id", "name", "goal_type", "account_name",
            money_out("target_amount").alias("target_amount"), money_out(done).alias("done"), "pct", "band",
        )
    )


def investment_accounts(accounts: DataFrame, n: int = 4) -> DataFrame:
    chosen = accounts.filter(F.col("type") == "investment").orderBy("type", "name", "id").limit(n)
    number = F.concat_ws(" ", "institution", F.coalesce("account_number", F.lit("")))
    return chosen.select("id", clip("name", 20).alias("name"), money_out("balance").alias("balance"), number.alias("label"))


def investment_transfers(
    txns: DataFrame, accounts: DataFrame, start: Column | dt.date, end: Column | dt.date
) -> DataFrame:
    """Transfers into an investment account or with an investment category."""
    rows = transfer_rows(txns, accounts, start, end)
    wanted = (F.coalesce("to_type", F.lit("")) == "investment") | (F.coalesce("inv_category", F.lit("")) != "")
    return rows.filter(wanted).select(
        "id",
        "date",
        clip("description", 40).alias("description"),
        "from_account",
        "to_account",
        F.coalesce(F.nullif("inv_category", F.lit("")), F.lit("General")).alias("category"),
        F.abs("amount").alias("amount"),
        "currency",
    )
