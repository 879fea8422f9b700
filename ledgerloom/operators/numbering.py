"""Dense row numbers and surrogate ids without sending all rows through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut_lineage


def key_bucket(keys: Sequence[str | Column], digits: int = 2) -> Column:
    """The first hex digits of a key hash: a bucket that is a pure function of the keys."""
    texts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.substring(F.md5(F.concat_ws("|", *texts)), 1, digits)


def assign_ids(
    rows: DataFrame, keys: Sequence[str | Column], start: DataFrame | None = None, name: str = "id", digits: int = 2,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Dense ids 1.. (or after the one value in ``start``) in (bucket, keys) order.

    The keys are unique, so the hash spreads them evenly over 16**digits buckets. Each
    bucket is numbered on its own; the offsets come from one count per bucket. Two
    digits suit dimension tables, four suit the fact table. ``order`` are columns that stand for keys which are made of them.
    """
    bucketed = rows.withColumn("_bucket", key_bucket(keys, digits))
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy(*(order or keys))
    base = F.lit(0) if start is None else F.coalesce(start.scalar(), F.lit(0))
    return (
        bucketed.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, "_bucket")
        .withColumn(name, (F.col("_rank") + F.col("_offset") + base).cast("bigint"))
        .drop("_bucket", "_rank", "_offset")
    )


def row_index(rows: DataFrame, order: Sequence[Column], name: str = "row_index") -> DataFrame:
    """0-based position of every row in a total order.

    A range-partitioned sort is kept by a reliable checkpoint, since positions must
    not move between the count and the use. Only one count per partition travels.
    """
    ordered = cut_lineage(rows.orderBy(*order).withColumn("_mono", F.monotonically_increasing_id()))
    placed = ordered.withColumns(
        {"_part": F.shiftright("_mono", 33), "_at": F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("_at") + F.col("_offset"))
        .drop("_mono", "_part", "_at", "_offset")
    )
