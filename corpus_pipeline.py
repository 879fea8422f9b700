"""A training corpus from the documents: five stages, each an operator over all that the one before kept.

All stages take tables with further columns of any name, and empty ones, which stay empty. Null texts are empty texts. Rows
that repeat others, or have no doc_id, are rows like any other where a stage doesn't say otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, mixing, quality, sharding, simhash
from ledgerloom.llm.common import Scratch, table
from ledgerloom.llm.queries import fold

# The network and the alignments can't be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from the labelled rows of four folds.

    Equal texts are judged alike. Without labelled rows every score is one half and all stay; with rows of one
    label alone all are judged by its share.
    """
    model = quality.train(quality.sampled(docs, table(spark, sf_dir, "labels"), fold(5) != 0))
    return docs.filter(quality.score(F.col("text"), model) >= quality.CUTOFF)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; one of those that repeat it or have none.

    Texts without words are a group.
    """
    return simhash.keep_first(docs, shingle=3, max_bits=2)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; with an empty benchmark all."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null source is a source of its own."""
    return mixing.mixed_rows(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and the slot of each row. Rows without a doc_id share a shard."""
    return sharding.assign(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


STAGES = [
    ("quality", good_documents),
    ("near_dedup", one_of_each),
    ("decontamination", without_leaks),
    ("mixing", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; what a stage has read is deleted when the next is written."""
    docs = table(spark, sf_dir, "documents")
    scratch, before = Scratch(spark, "pipeline"), None
    for _, stage in STAGES[:-1]:
        after = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
