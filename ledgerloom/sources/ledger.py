"""The fact table bucketed by fingerprint inside each month, so that batches meet it without moving it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators.maintain import first_of_each, months_of
from ledgerloom.operators.numbering import assign_ids
from ledgerloom.session import settings, stored
from ledgerloom.sources.tables import HIGH_WATER, completed, high_water

# The folder of the one row that says how a ledger is bucketed.
_LAYOUT = "_layout"


class Ledger:
    """A ledger at a path: partitioned by month, bucketed and sorted by fingerprint, its ids given by a high-water mark.

    The number of buckets stays for the life of the ledger; a month is never more files an append. Reports read the
    path or ``rows()`` like any other ledger. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.name = f"ledger_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({schemas.TRANSACTIONS}, rule_id BIGINT, month STRING) USING parquet PARTITIONED BY (month) "
            f"CLUSTERED BY (hash) SORTED BY (hash) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    @staticmethod
    def create(spark: SparkSession, path: str, buckets: int | None = None) -> Ledger:
        """An empty ledger; without ``buckets`` it has as many as the session has shuffle partitions."""
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.createDataFrame([(buckets,)], "buckets INT").coalesce(1).write.json(f"{path}/{_LAYOUT}")
        spark.createDataFrame([(0,)], "high BIGINT").coalesce(1).write.parquet(f"{path}/{HIGH_WATER}")
        return Ledger(spark, path, buckets)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Ledger:
        """The ledger that a session has left at ``path``."""
        ledger = Ledger(spark, path, spark.read.json(f"{path}/{_LAYOUT}", "buckets INT").first()["buckets"])
        spark.sql(f"ALTER TABLE {ledger.name} RECOVER PARTITIONS")
        return ledger

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unknown(self, batch: DataFrame) -> DataFrame:
        """The plan of ``new_rows``; it keeps the ledger in place where the session shuffles into as many partitions as it has buckets."""
        return first_of_each(batch).join(months_of(batch, self.rows()).select("hash"), "hash", "left_anti")

    def new_rows(self, batch: DataFrame) -> DataFrame:
        """Rows of the batch whose fingerprint is neither in the ledger nor earlier in the batch, written.

        Only the batch is shuffled, into the ledger's buckets; of the ledger one column of the batch's months is read as it lies.
        """
        with settings(self.spark, spark__sql__shuffle__partitions=str(self.buckets)):
            return stored(self.unknown(batch), "new-rows")

    def append(self, rows: DataFrame) -> int:
        """Appends written rows without ids, and gives their number. Ids are reserved first, so none is given twice."""
        high, count = high_water(self.spark, self.path), rows.count()
        if count:
            marks = self.spark.createDataFrame([(high + count,)], "high BIGINT").coalesce(1)
            marks.write.mode("append").parquet(f"{self.path}/{HIGH_WATER}")
            start = self.spark.createDataFrame([(high,)], "high BIGINT")
            keyed = completed(assign_ids(rows, ["hash"], start, digits=4)).withColumn("month", F.date_format("date", "yyyy-MM"))
            if "rule_id" not in keyed.columns:
                keyed = keyed.withColumn("rule_id", F.lit(None).cast("bigint"))
            table = self.rows().columns
            keyed.select(table).repartition(self.buckets, "hash").write.insertInto(self.name)
        return count
