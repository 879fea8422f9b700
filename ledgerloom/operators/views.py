"""Views over the ledger tables: joins with dimensions, unions and lookups.

Equi-joins carry no hint. Catalyst broadcasts a side whose size it knows to be
below autoBroadcastJoinThreshold, AQE does the same with measured sizes, and
anything larger is a sort-merge join whose skewed partitions AQE splits.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import MONEY
from ledgerloom.functions.text import UNCATEGORIZED, clip, no_tags, parse_tags
from ledgerloom.operators import filters

# What a category shows when nothing is set.
DEFAULT_ICON = "💰"
DEFAULT_COLOR = "#6b7280"

LEDGER_COLUMNS = [
    "id", "account_id", "date", "description", "original_desc", "amount", "memo", "notes", "is_split",
    "is_transfer", "transfer_to_account_id", "transfer_investment_cat", "currency", "ai_confidence", "tags",
    "account_name", "account_number", "parent_cat_name", "child_cat_name", "category",
]


def category_names(children: DataFrame, parents: DataFrame) -> DataFrame:
    """child_category_id with child and parent name and both income flags."""
    parent = parents.select(
        F.col("id").alias("parent_id"), F.col("name").alias("parent_category"), F.col("is_income").alias("parent_is_income")
    )
    child = children.select(
        F.col("id").alias("child_category_id"),
        "parent_id",
        F.col("name").alias("category"),
        F.col("is_income").alias("child_is_income"),
    )
    return child.join(parent, "parent_id")


def categorised(txns: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """Transactions with their category names; rows without a category drop out."""
    return txns.join(category_names(children, parents).drop("parent_id"), "child_category_id")


def _column_or(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def ledger_view(txns: DataFrame, accounts: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """The 20-column enriched ledger; absent optional columns are NULL."""
    account = accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"), "account_number")
    child = children.select(F.col("id").alias("child_category_id"), F.col("name").alias("child_cat_name"), "parent_id")
    parent = parents.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_cat_name"))
    wide = txns.join(child, "child_category_id", "left").join(parent, "parent_id", "left").join(account, "account_id", "left")
    null_text = F.lit(None).cast("string")
    zero = F.lit(0)
    return wide.withColumns(
        {
            "original_desc": _column_or(txns, "original_desc", null_text),
            "memo": _column_or(txns, "memo", null_text),
            "notes": _column_or(txns, "notes", null_text),
            "is_split": _column_or(txns, "is_split", zero),
            "is_transfer": _column_or(txns, "is_transfer", zero),
            "ai_confidence": _column_or(txns, "ai_confidence", F.lit(None).cast("decimal(5,2)")),
            "tags": parse_tags("tags"),
            "category": F.coalesce(F.nullif("child_cat_name", F.lit("")), F.lit(UNCATEGORIZED)),
        }
    ).select(*LEDGER_COLUMNS)


def ledger(
    txns: DataFrame,
    accounts: DataFrame,
    children: DataFrame,
    parents: DataFrame,
    *,
    account_id: int | None = None,
    start: Column | dt.date | None = None,
    end: Column | dt.date | None = None,
    category: str | None = None,
    search: str | None = None,
    payee: str | None = None,
    tags: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Filtered ledger, newest first. Steps: filters, first ``limit`` rows, then tags.

    The filters and the top-k run on the fact table alone. The dimension joins keep
    every row once, so with a limit they see only the kept rows.
    """
    rows = filters.between_dates(txns, start, end)
    if account_id is not None:
        rows = filters.by_account(rows, [account_id])
    for text in (search, payee):
        if text is not None:
            rows = filters.search(rows, text, wildcards=True)
    if category is not None:
        wanted = children.filter(F.col("name") == category).select(F.col("id").alias("child_category_id"))
        rows = rows.join(wanted, "child_category_id", "left_semi")
    if limit is not None:
        rows = filters.top_n(rows, limit, filters.sort_order())
    view = ledger_view(rows, accounts, children, parents)
    if tags:
        view = filters.with_any_tag(view, tags)
    return filters.sort_ledger(view)


def recent_transactions(
    txns: DataFrame, accounts: DataFrame, children: DataFrame, parents: DataFrame,
    start: Column | dt.date, end: Column | dt.date, n: int = 10,
) -> DataFrame:
    rows = ledger(txns, accounts, children, parents, start=start, end=end, limit=n)
    return rows.select(
        "id",
        "date",
        clip("description", 42).alias("description"),
        "category",
        F.col("amount").alias("amount"),
        clip("account_name", 18).alias("account"),
    )


def transfers(
    txns: DataFrame, accounts: DataFrame, start: Column | dt.date | None = None, end: Column | dt.date | None = None
) -> DataFrame:
    """Transfer rows with the names of both accounts and the destination's type, newest first."""
    return transfer_rows(txns, accounts, start, end).orderBy(F.col("date").desc(), F.col("id").desc())


def transfer_rows(
    txns: DataFrame, accounts: DataFrame, start: Column | dt.date | None = None, end: Column | dt.date | None = None
) -> DataFrame:
    """The rows of ``transfers`` in no order."""
    source = accounts.select(F.col("id").alias("account_id"), F.col("name").alias("from_account"))
    target = accounts.select(
        F.col("id").alias("transfer_to_account_id"), F.col("name").alias("to_account"), F.col("type").alias("to_type")
    )
    rows = filters.between_dates(filters.only_transfers(txns), start, end)
    return (
        rows.join(source, "account_id", "left")
        .join(target, "transfer_to_account_id", "left")
        .withColumn("inv_category", F.col("transfer_investment_cat"))
    )


def goals_view(goals: DataFrame, accounts: DataFrame) -> DataFrame:
    account = accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"))
    return goals.join(account, "account_id", "left").orderBy("id")


def splits_of(splits: DataFrame, children: DataFrame, txns: DataFrame | None = None) -> DataFrame:
    """Split lines with category names, for all transactions or those of a page, in one join."""
    child = children.select(F.col("id").alias("child_category_id"), F.col("name").alias("category"))
    lines = splits.join(child, "child_category_id")
    if txns is not None:
        lines = lines.join(txns.select(F.col("id").alias("transaction_id")), "transaction_id", "left_semi")
    return lines


def category_ids(children: DataFrame) -> DataFrame:
    """One id per category name: the smallest where a name repeats."""
    return children.groupBy(F.col("name").alias("category")).agg(F.min("id").alias("child_category_id"))


def resolve_category(df: DataFrame, children: DataFrame) -> DataFrame:
    """Adds child_category_id by name, NULL where the name is unknown."""
    return df.drop("child_category_id").join(category_ids(children), "category", "left")


def unresolved_categories(df: DataFrame, children: DataFrame) -> DataFrame:
    """Category names in use that the tree does not hold, with their row counts."""
    used = df.groupBy("category").agg(F.count(F.lit(1)).alias("rows"))
    return used.filter(F.col("category").isNotNull()).join(category_ids(children), "category", "left_anti")


def named_rules(rules: DataFrame, children: DataFrame) -> DataFrame:
    """Rules with category names, in no order."""
    child = children.select(F.col("id").alias("child_category_id"), F.col("name").alias("category"))
    return rules.join(child, "child_category_id").withColumn("use_count", F.coalesce("use_count", F.lit(0)))


def rules_view(rules: DataFrame, children: DataFrame) -> DataFrame:
    """Rules with category names in matching order."""
    view = named_rules(rules, children)
    return view.orderBy(F.col("priority").desc(), F.col("use_count").desc(), "id")


def categories_view(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Parents (parent NULL) and children in one list, parents first."""
    owner = parents.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    top = parents.withColumn("parent", F.lit(None).cast("string"))
    both = _shown(top).unionByName(_shown(children.join(owner, "parent_id")))
    return both.orderBy(F.col("parent").asc_nulls_first(), "name")


def _shown(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        "name",
        _column_or(df, "icon", F.lit(DEFAULT_ICON)).alias("icon"),
        _column_or(df, "color", F.lit(DEFAULT_COLOR)).alias("color"),
        "is_income",
        "parent",
    )


def category_paths(children: DataFrame, parents: DataFrame) -> DataFrame:
    names = category_names(children, parents)
    return names.select(
        "child_category_id", "category", F.concat_ws(" > ", "parent_category", "category").alias("category_path")
    )


def drilldown(view: DataFrame, report: DataFrame, kind: str) -> DataFrame:
    """Ledger rows behind a spending or income report: same category name and sign.

    Unlike the report's totals this keeps transfers.
    """
    names = report.select("category").distinct()
    return filters.by_flow(view, kind).join(names, "category", "left_semi")


def all_tags(txns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct non-empty tags, for each of the columns ``by``. Equal tag texts collapse map-side before they are parsed."""
    texts = txns.select(*by, "tags").filter(F.col("tags").isNotNull() & (F.col("tags") != "[]")).distinct()
    tags = texts.select(*by, F.explode(parse_tags("tags")).alias("tag"))
    return tags.filter(F.col("tag").isNotNull() & (F.col("tag") != "")).distinct().orderBy(*by, "tag")


def unused_tags(txns: DataFrame, of: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct tag text of the transactions ``of``: the known tags it lacks, sorted.

    With ``by``, the columns of a household, the known tags are its own: one sorted list a household, found
    once. Each distinct tag text is compared with it once, however many rows carry it.
    """
    listed = F.array_sort(F.collect_list("tag")).alias("known")
    sets = of.select(*by, F.coalesce("tags", F.lit("[]")).alias("tags")).distinct()
    if not by:
        known = all_tags(txns).agg(listed).scalar()
    else:
        own = all_tags(txns, by).groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(listed)
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        sets, known = sets.join(own, same, "left"), F.coalesce("known", F.array().cast("array<string>"))
    return sets.select(*by, "tags", F.array_except(known, parse_tags("tags")).alias("unused"))


def net_worth_parts(accounts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accounts that count: assets with their balance, liabilities negated; the columns ``by`` stay."""
    zero = F.lit(0).cast(MONEY)
    asset = F.col("type").isin("checking", "investment") & (F.coalesce("balance", zero) > 0)
    debt = F.col("type").isin("credit", "mortgage")
    value = F.when(asset, F.col("balance")).when(debt, -F.abs(F.coalesce("balance", zero)))
    kind = F.when(asset, F.lit("asset")).when(debt, F.lit("liability"))
    counted = accounts.filter(kind.isNotNull())
    return counted.select(*by, "id", "name", kind.alias("kind"), value.cast(MONEY).alias("value"))


def net_worth_bridge(accounts: DataFrame) -> DataFrame:
    """Asset rows, negated liability rows and the closing total."""
    parts = net_worth_parts(accounts).select("name", "kind", F.col("value").cast("decimal(38,2)").alias("value"))
    total = parts.agg(F.coalesce(F.sum("value"), F.lit(0)).cast("decimal(38,2)").alias("value"))
    return parts.unionByName(
        total.select(F.lit("Net Worth").alias("name"), F.lit("total").alias("kind"), "value")
    )
