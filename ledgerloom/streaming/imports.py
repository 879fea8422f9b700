"""Incremental import of a folder of statements."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.normalise import layout_of
from ledgerloom.plans.imports import import_frames
from ledgerloom.schemas import ACCOUNTS
from ledgerloom.sources.statements import (
    BAD, CSV_OPTIONS, LINEAGE, clean_header, read_statements, statement_schema, with_bad, with_missing_as_null,
)
from ledgerloom.sources.tables import append_transactions


def stream_statements(spark: SparkSession, folder: str, columns: Sequence[str], files_per_batch: int = 1000) -> DataFrame:
    """File-source stream of statements of one layout, all STRING.

    A file whose header doesn't name these columns in this order stops the stream with an error.
    """
    raw = (
        spark.readStream.schema(statement_schema([*columns, BAD]))
        .options(**{**CSV_OPTIONS, "enforceSchema": False, "maxFilesPerTrigger": files_per_batch})
        .csv(folder)
    )
    return with_missing_as_null(with_bad(raw, columns), columns).withColumnsRenamed({c: clean_header(c) for c in columns}).select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("source_block"),
    )


def arriving_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """File-source stream of the files that arrive, one row each: ``source_file``. No content is read for it."""
    listed = (
        spark.readStream.format("binaryFile")
        .schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    return listed.select(F.col("_metadata.file_path").alias("source_file"))


def import_stream(
    spark: SparkSession, folder: str, columns: Sequence[str] | None, institution: str | Column, ledger_path: str, accounts_path: str,
    children: DataFrame, rules: DataFrame, checkpoint: str, files_per_batch: int = 1000, given: DataFrame | None = None,
) -> StreamingQuery:
    """Imports the files that arrived since the last run, then stops.

    With ``columns`` all files have this one layout. Without, each file of a micro-batch is read by its own header, as the
    batch import does, and ``institution`` may be a column expression of ``source_file`` that says whose statement it is; a file
    for which it is NULL is left out. ``given`` has the account_name and account_number of files for which they aren't to be found out.

    Each micro-batch is normalised, categorised and compared with the ledger's partitions
    of its months, so a file that comes again, in the same run or later, adds nothing. New
    accounts are stored before the rows. A batch that is run again after a failure
    finds its own accounts and rows and adds none. Written rows keep rule_id, so
    ``rule_usage`` can count them. Ids follow the ledger's high-water mark, so no batch looks for the highest one.
    """
    whose = F.lit(institution) if isinstance(institution, str) else institution

    def frames_of(micro: DataFrame) -> list[tuple[DataFrame, str]]:
        if columns is not None:
            return [(micro.withColumn("source_row", F.monotonically_increasing_id()), institution)]
        # at most files_per_batch names
        named: dict[str, list[str]] = {}
        for row in micro.select("source_file", whose.alias("institution")).filter("institution IS NOT NULL").collect():
            named.setdefault(row["institution"], []).append(unquote(row["source_file"]))
        session = micro.sparkSession
        return [(df, name) for name, paths in named.items() for df in read_statements(session, paths, layout_of(name).spec).values()]

    def append(micro: DataFrame, _batch_id: int) -> None:
        session = micro.sparkSession
        frames = frames_of(micro)
        if not frames:
            return
        ledger = session.read.schema("id BIGINT, date DATE, hash STRING, month STRING").parquet(ledger_path)
        accounts = session.read.schema(ACCOUNTS).parquet(accounts_path)
        done = import_frames(frames, ledger, accounts, children, rules, given)
        done.accounts.join(accounts.select("id"), "id", "left_anti").write.mode("append").parquet(accounts_path)
        append_transactions(done.added.drop(*LINEAGE), ledger_path)

    if columns is None:
        arriving = arriving_files(spark, folder, files_per_batch)
    else:
        if not isinstance(institution, str):
            raise ValueError("files of one layout are of one institution")
        arriving = stream_statements(spark, folder, columns, files_per_batch)
    return (
        arriving.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
