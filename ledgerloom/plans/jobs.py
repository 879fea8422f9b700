"""Changes of a stored ledger: each reads and rewrites the months that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.maintain import apply_corrections, mark_transfers, replace_splits
from ledgerloom.session import stored
from ledgerloom.sources.tables import rewrite_months


def correct_ledger(spark: SparkSession, path: str, changes: DataFrame, children: DataFrame) -> list[str]:
    """``apply_corrections`` on the ledger at ``path``; gives the months rewritten."""
    return rewrite_months(spark, path, changes.select("id"), lambda part: apply_corrections(part, changes, children))


def mark_ledger(spark: SparkSession, path: str, marks: DataFrame) -> list[str]:
    """``mark_transfers`` on the ledger at ``path``; gives the months rewritten."""
    return rewrite_months(spark, path, marks.select("id"), lambda part: mark_transfers(part, marks))


def split_ledger(
    spark: SparkSession, path: str, splits: DataFrame, new: DataFrame, children: DataFrame
) -> tuple[DataFrame, list[str]]:
    """``replace_splits``: the new split table, and the months of the ledger at ``path`` that got flags.

    The split table is written below the shared folder before the flags, so that a job that fails can run again.
    """
    none = spark.read.parquet(path).limit(0)
    table = stored(replace_splits(splits, none, new, children)[0], "splits")
    ids = new.select(F.col("transaction_id").alias("id"))
    return table, rewrite_months(spark, path, ids, lambda part: replace_splits(splits, part, new, children)[1])
