"""What the document operators share: written tables, word and span columns."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import shared_folder

# A word, and the blanks between words, as the operators' contracts fix them.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

# Spans are appended to arrays block by block, since appending to one long array costs its square.
SPAN_BLOCK = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(df: DataFrame) -> DataFrame:
    """Gives the executors this package, once a session, so that Python inside tasks finds it wherever it is installed.

    The archive lies in the shared folder, from where Spark hands it to every executor.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not getattr(context, "_llm_shipped", False):
        root = Path(__file__).resolve().parents[2]
        archive = io.BytesIO()
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted((root / "ledgerloom").rglob("*.py")):
                out.write(path, path.relative_to(root))
        name = f"{shared_folder(spark, 'ledgerloom')}.zip"
        target = spark._jvm.org.apache.hadoop.fs.Path(name)
        stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
        stream.write(bytearray(archive.getvalue()))
        stream.close()
        context.addPyFile(name)
        context._llm_shipped = True
    return df


class Scratch:
    """Tables written below the shared folder; each outlives lost executors and can be dropped after use."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = shared_folder(spark, purpose)
        self._made = 0

    def keep(self, df: DataFrame, *by: str) -> DataFrame:
        """Writes a frame, in a folder for each value of ``by``, and reads it back."""
        self._made += 1
        path = f"{self.root}/{self._made}"
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *kept: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for df in kept:
            self.remove(df._scratch_path)

    def remove(self, folder: str) -> None:
        """Deletes a folder below the shared one."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def sampled_ids(rows: DataFrame, count: int, seed: str, *more: str) -> DataFrame:
    """The ``count`` smallest doc_ids by a seeded hash, with the columns ``more``; texts don't travel for it."""
    ids = rows.filter("doc_id IS NOT NULL").select("doc_id", *more)
    return ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", *more).limit(count)


def texts_of(docs: DataFrame, chosen: DataFrame, text: Column, *more: str) -> DataFrame:
    """``(doc_id, text)`` and the columns ``more`` for the ids of a bounded sample, one row an id.

    The sample's bound is its caller's parameter, so it is broadcast and the documents are only
    filtered. Of rows that share an id the least text counts, and the largest of ``more``.
    """
    sample = F.broadcast(chosen.withColumnRenamed("doc_id", "chosen_id"))
    found = docs.select("doc_id", text.alias("text")).join(sample, F.col("doc_id") == F.col("chosen_id"))
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), *(F.max(c).alias(c) for c in more))


def word_count(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stringed(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def match_spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern as ``array<struct<start, end, found>>``, in code points, end exclusive.

    The pieces between the matches and the matches themselves come from the same leftmost
    search; a running sum of their lengths gives the positions. Matches are never empty.
    Only a text with matches pays for the second search.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    pairs = F.arrays_zip(
        F.transform(F.slice(pieces, 1, F.size(found)), lambda p: F.length(p)).alias("gap"), found.alias("found")
    )
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.when(F.size(found) == 0, none).otherwise(_placed(pairs))


def _placed(pairs: Column) -> Column:
    """Positions of (gap, found) pairs: a running sum per block, and one over the blocks."""
    size = F.size(pairs)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((size - 1) / SPAN_BLOCK).cast("int")),
        lambda b: F.slice(pairs, b * SPAN_BLOCK + 1, SPAN_BLOCK),
    )

    def width(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda n, p: n + p["gap"] + F.length(p["found"]))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["found"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    def first(at: Column) -> Column:
        out = F.array().cast("array<struct<start:int,end:int,found:string>>")
        return F.struct(at.alias("at"), out.alias("out"))

    offsets = F.aggregate(
        blocks,
        F.array(F.lit(0)),
        lambda acc, block: F.concat(acc, F.array(F.element_at(acc, -1) + width(block))),
    )
    return F.flatten(
        F.zip_with(
            blocks,
            offsets,
            lambda block, at: F.when(
                block.isNotNull(), F.aggregate(block, first(at), step, lambda state: state["out"])
            ).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>")),
        )
    )
