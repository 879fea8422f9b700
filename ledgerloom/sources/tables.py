"""Ledger tables: scan, partitioned write, export and seed load."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom import schemas
from ledgerloom.functions.money import MONEY
from ledgerloom.functions.text import fingerprint_bytes, fingerprint_text, tags_json
from ledgerloom.operators.numbering import assign_ids
from ledgerloom.session import stored

# The columns of an export, in order.
EXPORT_COLUMNS = [
    "date", "description", "category", "amount", "currency", "account_name", "memo", "tags", "is_split",
]

# The folder of a ledger's high-water marks; scans pass over names that begin like this.
HIGH_WATER = "_high_water"

TABLES = {
    "parent_categories": schemas.PARENT_CATEGORIES,
    "child_categories": schemas.CHILD_CATEGORIES,
    "accounts": schemas.ACCOUNTS,
    "transactions": schemas.TRANSACTIONS,
    "split_transactions": schemas.SPLITS,
    "categorization_rules": schemas.RULES,
    "budgets": schemas.BUDGETS,
    "goals": schemas.GOALS,
}


def write_transactions(df: DataFrame, path: str, mode: str = "append") -> None:
    """The fact table, one directory per month so that period filters prune files.

    The rebalance hint lets AQE split a month that holds most rows into files of the
    advisory size and merge the small ones.
    """
    keyed = _packed(completed(df)).withColumn("month", F.date_format("date", "yyyy-MM"))
    _unpacked(keyed.hint("rebalance", F.col("month"))).write.mode(mode).partitionBy("month").parquet(path, compression="zstd")


# The bytes of an MD5 fingerprint while rows are moved; ``hash`` holds any other text then.
_PRINT = "_print"


def _packed(df: DataFrame) -> DataFrame:
    if _PRINT in df.columns or "hash" not in df.columns:
        return df
    packed = df.withColumn(_PRINT, fingerprint_bytes("hash"))
    return packed.withColumn("hash", F.when(F.col(_PRINT).isNull(), F.col("hash")))


def _whole_hash() -> Column:
    return F.coalesce(fingerprint_text(_PRINT), F.col("hash"))


def _unpacked(df: DataFrame) -> DataFrame:
    return df.withColumn("hash", _whole_hash()).drop(_PRINT)


def completed(df: DataFrame) -> DataFrame:
    """``df`` with all columns of the fact table; those it lacks are NULL."""
    schema = StructType.fromDDL(schemas.TRANSACTIONS)
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns})


def rewrite_months(spark: SparkSession, path: str, ids: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Replaces the months of the ledger at ``path`` that hold one of ``ids`` (id) by what ``change`` makes of them.

    One scan of the id column finds the months. Only those partitions are read and
    overwritten, others keep their files. The new rows are written aside first, as a folder can't be
    overwritten while it is read. ``change`` keeps rows in their month. One writer at a time.
    """
    ledger = spark.read.parquet(path)
    wanted = ids.select(F.col("id").alias("changed_id")).distinct()
    found = ledger.select("id", "month").join(wanted, F.col("id") == F.col("changed_id"), "left_semi").select("month").distinct()
    months = sorted(r["month"] for r in found.collect())
    if months:
        part = completed(ledger.filter(F.col("month").isin(months)))
        changed = stored(change(part), "rewritten")
        rows = changed.hint("rebalance", F.col("month")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        rows.partitionBy("month").parquet(path)
    return months


def high_water(spark: SparkSession, path: str) -> int:
    """The highest id that the ledger at ``path`` has given out: from its small table, which a first call makes by one scan."""
    marks = f"{path}/{HIGH_WATER}"
    try:
        return spark.read.schema("high BIGINT").parquet(marks).agg(F.max("high")).first()[0] or 0
    except AnalysisException:
        high = spark.read.schema("id BIGINT, month STRING").parquet(path).agg(F.max("id")).first()[0] or 0
        spark.createDataFrame([(high,)], "high BIGINT").coalesce(1).write.parquet(marks)
        return high


def append_transactions(rows: DataFrame, path: str, keys: Sequence[str] = ("hash",)) -> None:
    """Appends written rows without ids to the ledger at ``path``; their ids follow its high-water mark.

    The ids are reserved before the rows are written, so an append that fails leaves a gap at most and no id is given twice.
    One append at a time.
    """
    spark = rows.sparkSession
    high, count = high_water(spark, path), rows.count()
    if count:
        marks = spark.createDataFrame([(high + count,)], "high BIGINT").coalesce(1)
        marks.write.mode("append").parquet(f"{path}/{HIGH_WATER}")
        start = spark.createDataFrame([(high,)], "high BIGINT")
        packed = _packed(rows)
        whole = [_whole_hash() if k == "hash" else k for k in keys]
        # the bytes have the order of the texts
        order = [k for key in keys for k in ([_PRINT, key] if key == "hash" else [key])]
        write_transactions(assign_ids(packed, whole, start, digits=4, order=order), path)


def load_ledger(spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Scan of the fact table. The period becomes a partition filter and a file filter."""
    ledger = spark.read.parquet(path)
    if start is not None:
        ledger = ledger.filter((F.col("month") >= start.strftime("%Y-%m")) & (F.col("date") >= F.lit(start)))
    if end is not None:
        ledger = ledger.filter((F.col("month") <= end.strftime("%Y-%m")) & (F.col("date") <= F.lit(end)))
    return ledger.drop("month")


def export_frame(view: DataFrame) -> DataFrame:
    """The export columns that are present, tags as JSON text."""
    keep = [c for c in EXPORT_COLUMNS if c in view.columns]
    columns: list[Column] = []
    for c in keep:
        is_array = dict(view.dtypes)[c].startswith("array")
        columns.append(tags_json(c).alias(c) if c == "tags" and is_array else F.col(c))
    return view.select(*columns)


def export_csv(view: DataFrame, path: str) -> None:
    """CSV parts with a header; every task writes its own part, nothing is gathered."""
    export_frame(view).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def seed_categories(parents: DataFrame, children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seed rows to the two category tables.

    parents(name, is_income[, color, icon]); children(parent, name, is_income[, color, icon]).
    A child whose parent name is unknown is left out.
    """
    parent_table = _with_optional(assign_ids(parents, ["name"]), ["color", "icon"]).select(
        "id", "name", "color", "icon", F.coalesce("is_income", F.lit(0)).alias("is_income")
    )
    owner = parent_table.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    joined = _with_optional(children, ["color", "icon"]).join(owner, "parent")
    child_table = assign_ids(joined, ["parent", "name"]).select(
        "id", "parent_id", "name", "color", "icon", F.coalesce("is_income", F.lit(0)).alias("is_income")
    )
    return parent_table, child_table


def seed_budgets(seeds: DataFrame, parents: DataFrame, children: DataFrame, effective: dt.date) -> DataFrame:
    """seeds(parent, child, amount) to budget rows of one effective date."""
    owner = parents.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    target = children.select(F.col("id").alias("child_category_id"), F.col("name").alias("child"), "parent_id")
    joined = seeds.join(target.join(owner, "parent_id"), ["parent", "child"])
    return assign_ids(joined, ["parent", "child"]).select(
        "id",
        "child_category_id",
        F.lit(effective).alias("month_year"),
        F.col("amount").cast(MONEY).alias("amount"),
        F.lit(0).alias("carry_forward"),
        F.lit("none").alias("carry_forward_type"),
    )


def _with_optional(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})
