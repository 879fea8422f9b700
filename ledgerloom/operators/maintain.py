"""Batch maintenance: ledger tables in, new ledger tables out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import MONEY
from ledgerloom.operators.numbering import assign_ids
from ledgerloom.operators.views import category_ids
from ledgerloom.sources.statements import LINEAGE


def first_of_each(batch: DataFrame, key: str = "hash", order: Sequence[str] = LINEAGE) -> DataFrame:
    """Keeps the first row per fingerprint.

    ``row_number() = 1`` is planned with a group limit before the shuffle, so each
    task sends one row per fingerprint however often it repeats.
    """
    present = [c for c in order if c in batch.columns]
    ranked = batch.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*present)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def months_of(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """The ledger's partitions of the batch's months, all of it if it isn't stored by month.

    A fingerprint holds the date, so no other month can hold the same one. The months
    of a batch are few whatever its size, and become a partition filter.
    """
    if "month" not in ledger.columns or "date" not in batch.columns:
        return ledger
    months = [r[0] for r in batch.select(F.date_format("date", "yyyy-MM")).distinct().collect()]
    return ledger.filter(F.col("month").isin([m for m in months if m is not None]))


def new_rows(batch: DataFrame, ledger: DataFrame, key: str = "hash", order: Sequence[str] = LINEAGE) -> DataFrame:
    """Batch rows whose fingerprint is neither in the ledger nor earlier in the batch.

    Both steps use the same key, so the batch is shuffled once. Of the ledger only the
    key column is read, and of a ledger with its ``month`` column only the batch's months.
    """
    ledger = months_of(batch, ledger)
    return first_of_each(batch, key, order).join(ledger.select(key), key, "left_anti")


def append_new(
    ledger: DataFrame, batch: DataFrame, key: str = "hash", order: Sequence[str] = LINEAGE
) -> tuple[DataFrame, DataFrame]:
    """(ledger with the new rows, counts parsed / inserted / skipped)."""
    added = new_rows(batch, ledger, key, order)
    counts = batch.agg(F.count(F.lit(1)).alias("parsed")).withColumn("inserted", added.agg(F.count(F.lit(1))).scalar())
    grown = ledger.unionByName(added.select(*[c for c in added.columns if c in ledger.columns]), allowMissingColumns=True)
    return grown, counts.withColumn("skipped", F.col("parsed") - F.col("inserted"))


def check_constraints(
    batch: DataFrame, not_null: Sequence[str], dims: Mapping[str, DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """(rows that fit, rejected rows with a reason).

    ``dims`` maps a foreign key column to its table (key column id). A NULL foreign
    key is allowed unless the column is in ``not_null``. A column with a NULL is
    reported before a broken key.
    """
    checked = batch
    reasons: list[Column] = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in not_null]
    flags = []
    for column, dim in dims.items():
        flag = f"_has_{column}"
        keys = dim.select(F.col("id").alias(column), F.lit(1).alias(flag)).distinct()
        checked = checked.join(keys, column, "left")
        flags.append(flag)
        reasons.append(F.when(F.col(column).isNotNull() & F.col(flag).isNull(), F.lit(f"{column} is unknown")))
    judged = checked.withColumn("reason", F.coalesce(*reasons)).drop(*flags)
    columns = batch.columns
    return (
        judged.filter(F.col("reason").isNull()).select(columns),
        judged.filter(F.col("reason").isNotNull()).select(*columns, "reason"),
    )


# The two keys of an account: with and without a number.
_BY_NUMBER, _BY_NAME = ["institution", "account_number"], ["institution", "name"]


def _has_number() -> Column:
    return F.coalesce(F.col("account_number"), F.lit("")) != ""


def add_accounts(accounts: DataFrame, new: DataFrame) -> DataFrame:
    """The account table with the unknown accounts of new(name, institution, type, account_number) added.

    The key is (institution, account_number) where a number is given, else (name,
    institution); numbered rows of the batch count as known to the others. Known
    accounts are not changed.
    """
    def one_each(rows: DataFrame, keys: list[str]) -> DataFrame:
        rest = [c for c in ("name", "institution", "type", "account_number", "currency", "balance") if c not in keys]
        order = F.struct(*[c for c in ("name", "type") if c not in keys])
        return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")

    wanted = _account_defaults(new)
    numbered = one_each(wanted.filter(_has_number()), _BY_NUMBER).join(accounts.select(*_BY_NUMBER), _BY_NUMBER, "left_anti")
    known = accounts.select(*_BY_NAME).unionByName(numbered.select(*_BY_NAME))
    unnumbered = one_each(wanted.filter(~_has_number()), _BY_NAME).join(known, _BY_NAME, "left_anti")
    columns = ["name", "institution", "type", "account_number", "currency", "balance"]
    fresh = numbered.select(columns).unionByName(unnumbered.select(columns))
    added = assign_ids(fresh, ["institution", "name", "account_number"], accounts.agg(F.max("id")))
    return accounts.select("id", *columns).unionByName(added.select("id", *columns))


def account_ids(table: DataFrame, new: DataFrame) -> DataFrame:
    """new with the account_id of each row, found by the same keys."""
    by_number = table.filter(F.col("account_number").isNotNull()).groupBy(*_BY_NUMBER).agg(F.min("id").alias("account_id"))
    by_name = table.groupBy(*_BY_NAME).agg(F.min("id").alias("account_id"))
    return new.filter(_has_number()).join(by_number, _BY_NUMBER, "left").unionByName(
        new.filter(~_has_number()).join(by_name, _BY_NAME, "left")
    )


def upsert_accounts(accounts: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(account table with the unknown accounts added, new rows with their account_id)."""
    table = add_accounts(accounts, new)
    return table, account_ids(table, new)


def _account_defaults(new: DataFrame) -> DataFrame:
    currency = F.coalesce("currency", F.lit("CAD")) if "currency" in new.columns else F.lit("CAD")
    balance = F.coalesce(F.col("balance").cast(MONEY), F.lit(0).cast(MONEY)) if "balance" in new.columns else F.lit(0).cast(MONEY)
    return new.withColumns({"currency": currency, "balance": balance})


def add_categories(
    children: DataFrame, parents: DataFrame, new: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(parent table, child table) with new(name, parent, is_income[, icon, color, ...]) added.

    Rows without a parent become parents, one per name (of several the least by the other
    columns); rows under an unknown parent are ignored. Parent names are unique, so a
    parent that exists is left as it is. Both tables keep all their columns; a column
    that the new rows lack is NULL in them.
    """
    top = new.filter(F.coalesce("parent", F.lit("")) == "").drop("parent")
    rest = [c for c in top.columns if c != "name"]
    one = top.groupBy("name").agg(F.min(F.struct(*rest)).alias("r")).select("name", "r.*")
    fresh = one.join(parents.select("name"), "name", "left_anti")
    parent_rows = assign_ids(fresh, ["name"], parents.agg(F.max("id")))
    parent_table = _grown(parents, parent_rows)
    owner = parent_table.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    below = new.filter(F.coalesce("parent", F.lit("")) != "").join(owner, "parent").drop("parent")
    child_rows = assign_ids(below, ["parent_id", "name"], children.agg(F.max("id")))
    return parent_table, _grown(children, child_rows)


def _grown(table: DataFrame, added: DataFrame) -> DataFrame:
    """The table with rows added, all columns of both; those of the table come first."""
    return table.unionByName(added, allowMissingColumns=True)


def _needs_seq(changes: DataFrame) -> None:
    """Changes are applied in turn, so they need an order that is unique per key."""
    if "seq" not in changes.columns:
        raise ValueError("changes need a column seq, their order per key")


def apply_corrections(ledger: DataFrame, changes: DataFrame, children: DataFrame) -> DataFrame:
    """Ledger after changes(id, category, tags, notes, seq), applied in the order of ``seq``.

    NULL leaves a field as it is and an unknown category changes nothing, so of each
    field the last value that says something stays, whichever change it came with.
    """
    _needs_seq(changes)
    named = changes.join(category_ids(children), "category", "left")

    def last(field: str) -> Column:
        return F.max_by(field, F.when(F.col(field).isNotNull(), F.col("seq")))

    final = named.groupBy("id").agg(
        last("child_category_id").alias("_child"), last("tags").alias("_tags"), last("notes").alias("_notes")
    )
    notes = F.col("notes") if "notes" in ledger.columns else F.lit(None).cast("string")
    joined = ledger.withColumn("notes", notes).join(final, "id", "left")
    return joined.withColumns(
        {
            "child_category_id": F.coalesce("_child", "child_category_id"),
            "tags": F.coalesce("_tags", "tags"),
            "notes": F.coalesce("_notes", "notes"),
        }
    ).drop("_child", "_tags", "_notes")


def mark_transfers(ledger: DataFrame, marks: DataFrame) -> DataFrame:
    """Ledger after marks(id, dest_account_id, inv_category, seq): those rows become transfers, the last mark of each holds."""
    _needs_seq(marks)
    final = F.max_by(F.struct("dest_account_id", "inv_category"), "seq").alias("r")
    marked = marks.groupBy("id").agg(final).select("id", "r.*", F.lit(1).alias("_mark"))
    hit = F.col("_mark") == 1
    joined = ledger.join(marked, "id", "left")
    return joined.withColumns(
        {
            "is_transfer": F.when(hit, 1).otherwise(F.col("is_transfer")),
            "transfer_to_account_id": F.when(hit, F.col("dest_account_id")).otherwise(F.col("transfer_to_account_id")),
            "transfer_investment_cat": F.when(hit, F.col("inv_category")).otherwise(F.col("transfer_investment_cat")),
        }
    ).drop("_mark", "dest_account_id", "inv_category")


def replace_splits(
    splits: DataFrame, ledger: DataFrame, new: DataFrame, children: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(split table, ledger) after new(transaction_id, line, category, amount[, memo]) replaces those transactions' lines.

    A line with an unknown category is dropped; its transaction still counts as split.
    Lines of other transactions keep all their columns.
    """
    touched = new.select("transaction_id").distinct()
    kept = splits.join(touched, "transaction_id", "left_anti")
    lines = new.join(category_ids(children), "category").withColumn("amount", F.col("amount").cast(MONEY))
    added = assign_ids(lines, ["transaction_id", "line"], splits.agg(F.max("id")), digits=4).drop("category")
    if "line" not in splits.columns:
        added = added.drop("line")
    flagged = ledger.join(touched.select(F.col("transaction_id").alias("id"), F.lit(1).alias("_split")), "id", "left")
    return (
        _grown(kept.select(splits.columns), added),
        flagged.withColumn("is_split", F.coalesce("_split", "is_split")).drop("_split"),
    )


def auto_balance(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """lines(transaction_id, line, amount) with what is left put on the last line.

    For two lines this makes the second one total - first; for more it is "fill
    remaining". The rest is total minus the allocated sum, which is aggregated
    map-side; only the last line of a transaction changes.
    """
    sums = lines.groupBy("transaction_id").agg(
        F.sum("amount").alias("_allocated"), F.max("line").alias("_last")
    )
    joined = lines.join(sums, "transaction_id").join(
        totals.select(F.col("id").alias("transaction_id"), F.col("amount").alias("_total")), "transaction_id"
    )
    rest = F.when(F.col("line") == F.col("_last"), F.col("_total") - F.col("_allocated")).otherwise(0)
    return joined.withColumn("amount", (F.col("amount") + rest).cast(MONEY)).drop("_allocated", "_last", "_total")
