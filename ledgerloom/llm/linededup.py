"""Line deduplication with levelled sorted runs of line hashes.

Documents come in batches. The hashes of a batch's long lines are anti-joined with the runs
written so far, each run sorted by hash; what is left is new, and forms the next run together with
the document that owns it. ``FANOUT`` runs of a level are merged into one of the next, so a hash is
rewritten once per level and a batch meets a logarithmic number of runs. A line stays only in
the document that owns its hash: in the earliest batch, and there in the smallest doc_id.

Column expressions only. Owner and document are part of the join keys, so a line that stands in
every third document is one row per run and its copies spread over all tasks.
"""

from __future__ import annotations

import json
import uuid
from contextlib import AbstractContextManager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import BLANKS, Scratch, stringed
from ledgerloom.session import settings, shared_folder

LEAST_CHARS = 10
FANOUT = 2
BATCHES = 4

# ASCII letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without the blanks at its ends, ASCII letters in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_hash(key: Column) -> Column:
    """128 bits, so that unequal lines of any corpus have unequal hashes."""
    return F.struct(F.xxhash64(key).alias("high"), F.xxhash64(F.lit(1), key).alias("low"))


def lines_of(rows: DataFrame) -> DataFrame:
    """``(doc_id, row, at, high, low)`` and the columns beside: the long lines of ``(doc_id, row, text)``, ``at`` counting from 0."""
    beside = [c for c in rows.columns if c not in ("doc_id", "row", "text")]
    long = rows.select("doc_id", "row", *beside, F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).filter(
        F.length(F.btrim("line", F.lit(BLANKS))) >= LEAST_CHARS
    )
    return long.select("doc_id", "row", *beside, "at", line_hash(line_key(F.col("line"))).alias("hash")).select(
        "doc_id", "row", *beside, "at", "hash.high", "hash.low"
    )


_RUN = "high long, low long, owner long"


class LineRuns:
    """The runs, and what to do with the next batch. Runs are ``(high, low, owner)`` tables of unique hashes.

    A run is a bucketed table, each bucket one file sorted by hash, so batches and other runs are merged
    with it bucket by bucket: nothing of a run is shuffled or sorted again. ``buckets`` stays for the life of the
    runs; it is the session's number of shuffle partitions when they begin. The manifest names the runs of each level
    and is written after them, so a batch that failed can come again and another session can go on.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.path = path or shared_folder(spark, "line-runs")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.scratch = Scratch(spark, "line-drops")
        self.levels: list[list[str]] = []
        self._seq = 0
        self._names: dict[str, str] = {}

    @staticmethod
    def open(spark: SparkSession, path: str) -> LineRuns:
        """The runs that a session has left at ``path``."""
        rows = spark.read.json(f"{path}/manifest/*", "seq int, state string").collect()
        state = json.loads(max(rows, key=lambda r: r["seq"])["state"])
        runs = LineRuns(spark, path, state["fanout"], state["buckets"])
        runs.levels, runs._seq = state["levels"], state["seq"]
        return runs

    def run(self, name: str) -> DataFrame:
        """A run as a table whose buckets and order the session knows."""
        if name not in self._names:
            self._names[name] = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(
                f"CREATE TABLE {self._names[name]} ({_RUN}) USING parquet CLUSTERED BY (high, low) SORTED BY (high, low) "
                f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
            )
        return self.spark.table(self._names[name])

    def _write(self, rows: DataFrame) -> str:
        """A new run of ``rows``, which lie in as many partitions by hash as there are buckets."""
        self._seq += 1
        name = f"run-{self._seq}"
        self._names[name] = f"line_run_{uuid.uuid4().hex}"
        writer = rows.write.mode("overwrite").bucketBy(self.buckets, "high", "low").sortBy("high", "low")
        writer.option("path", f"{self.path}/{name}").saveAsTable(self._names[name])
        return name

    def unknown(self, owned: DataFrame) -> DataFrame:
        """``owned`` without the hashes that a run holds: a merge with one run after the other."""
        for name in [name for level in self.levels for name in level]:
            owned = owned.join(self.run(name).select("high", "low"), ["high", "low"], "left_anti")
        return owned

    def merged(self, names: list[str]) -> DataFrame:
        """Runs in one. They share no hash, so a full outer join of sorted buckets is their merge."""
        out = self.run(names[0])
        for name in names[1:]:
            out = out.alias("a").join(self.run(name).alias("b"), ["high", "low"], "full_outer").select("high", "low", F.coalesce("a.owner", "b.owner").alias("owner"))
        return out

    def add(self, lines: DataFrame) -> DataFrame:
        """Takes a written batch of lines, and gives the lines to drop, written: ``(doc_id, row, at)``.

        A null doc_id owns a hash only if no other document of the batch holds it.
        """
        with sorted_buckets(self.spark, self.buckets):
            owned = lines.groupBy("high", "low").agg(F.min("doc_id").alias("owner"))
            fresh = self._write(self.unknown(owned))
            mine = self.run(fresh).select(F.col("high").alias("run_high"), F.col("low").alias("run_low"), "owner")
            same = (
                (F.col("high") == F.col("run_high"))
                & (F.col("low") == F.col("run_low"))
                & F.col("doc_id").eqNullSafe(F.col("owner"))
            )
            drops = self.scratch.keep(lines.join(mine, same, "left_anti").select("doc_id", "row", "at"))
            old = self._push(fresh, 0)
        self._commit()
        self._drop(old)
        return drops

    def _push(self, name: str, level: int) -> list[str]:
        """Puts a run into a level and merges a full level into the next; gives the runs that are no longer needed."""
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(names := self.levels[level]) < self.fanout:
            return []
        self.levels[level] = []
        return [*names, *self._push(self._write(self.merged(names)), level + 1)]

    def _commit(self) -> None:
        state = json.dumps({"levels": self.levels, "fanout": self.fanout, "buckets": self.buckets, "seq": self._seq})
        self.spark.createDataFrame([(self._seq, state)], "seq int, state string").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/{self._seq}")

    def _drop(self, names: list[str]) -> None:
        for name in names:
            if table := self._names.pop(name, None):
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            self.scratch.remove(f"{self.path}/{name}")

    def close(self) -> None:
        """Deletes all runs."""
        self._drop([name for level in self.levels for name in level])
        self.scratch.remove(self.path)
        self.levels = []


def sorted_buckets(spark: SparkSession, buckets: int) -> AbstractContextManager[None]:
    """Shuffles into as many partitions as there are buckets, and lets scans of one sorted file a bucket say that they are sorted."""
    return settings(spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true", spark__sql__shuffle__partitions=str(buckets))


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept``, one row per row; ``kept`` is the text without the dropped lines.

    Batches are ranges of doc_id in rising order, so the owner of a line is the smallest doc_id
    that holds it. Null and empty texts are one empty line. A line held by one document only
    stays, however often, also where rows repeat the doc_id. A null doc_id counts as
    the last document, all such rows as one. Texts are split into lines once, whatever the number of batches.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), stringed(F.col(text_col)).alias("text")).withColumn(
        "row", F.xxhash64("text")
    )
    bounds = rows.approxQuantile("doc_id", [n / batches for n in range(1, batches)], 0.01) if batches > 1 else []
    edges = sorted({int(b) for b in bounds})
    # the first batch whose range holds the doc_id, the last one for those without
    batch = F.coalesce(*(F.when(F.col("doc_id") <= edge, n) for n, edge in enumerate(edges)), F.lit(len(edges)))
    scratch = Scratch(spark, "lines")
    lines = scratch.keep(lines_of(rows.withColumn("batch", batch)), "batch")
    runs = LineRuns(spark, fanout=fanout)
    dropped = None
    for number in range(len(edges) + 1):
        drops = runs.add(lines.filter(F.col("batch") == number).drop("batch"))
        dropped = drops if dropped is None else dropped.unionAll(drops)
    scratch.drop(lines)
    runs.close()
    return without(rows, dropped)


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Puts the rows together without the lines of ``(doc_id, row, at)``."""
    by_row = dropped.groupBy(F.col("doc_id").alias("drop_id"), F.col("row").alias("drop_row")).agg(
        F.collect_set("at").alias("gone")
    )
    same = F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("row") == F.col("drop_row"))
    lines = F.split("text", "\n", -1)
    joined = rows.join(by_row, same, "left").select("doc_id", "text", lines.alias("lines"), "gone")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda at: F.element_at("lines", at + 1)), "\n")
    )
    return joined.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )
