"""Exact deduplication over a cuckoo-filter index of live digests.

The index is split into parts by a hash of the digest. Each part has a cuckoo filter, one row of a
small table, and its content, the stored keys: digest, owner and number of rows. A batch of digests
meets the filters first. What the filter doesn't know is new. What it may know is verified against
the content by its whole digest, so a false hit is new as well. New keys go to the content as a table
of the batch and into the filters; a filter that overflows is made again, twice as large or more, from
the stored keys of its part. Deleting takes verified digests out of the filters and writes them down as gone.

Every batch is a folder of its own below the index, its manifest row written last, so a batch that
failed is simply written again, and another session can go on with the index.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, shipped, stringed
from ledgerloom.session import shared_folder

SLOTS = 4
FULL = 0.9  # no part is planned fuller than this
MAX_ROUNDS = 200
KEYS_PER_PART = 250_000
LEAST_PARTS = 64
LEAST_BUCKETS = 64
BATCHES = 4

_KEYS = "part int, digest binary, owner long, size long, seq int"
_FILTERS = "part int, buckets long, cells binary, overflow boolean"


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four; all operations take arrays of 64-bit hashes."""

    def __init__(self, buckets: int, cells: bytes | None = None):
        self.buckets = buckets
        held = np.zeros(buckets * SLOTS, np.uint16) if cells is None else np.frombuffer(cells, np.uint16).copy()
        self.cells = held.reshape(buckets, SLOTS)

    @staticmethod
    def sized(keys: int) -> CuckooFilter:
        """An empty filter that has room for so many keys."""
        buckets = LEAST_BUCKETS
        while buckets * SLOTS * FULL < keys:
            buckets *= 2
        return CuckooFilter(buckets)

    @staticmethod
    def of(hashes: np.ndarray, least: int = 0) -> CuckooFilter:
        """A filter made from stored keys, doubled until all have a place."""
        made = CuckooFilter.sized(max(len(hashes), least))
        while not made.insert(hashes):
            made = CuckooFilter(made.buckets * 2)
        return made

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints, never 0, and first buckets."""
        marks = (hashes >> np.uint64(48)).astype(np.uint16)
        return np.where(marks == 0, np.uint16(1), marks), (hashes & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, marks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The other bucket of a fingerprint, known from either of its two."""
        spread = marks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
        return at ^ (spread & np.uint64(self.buckets - 1)).astype(np.int64)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        marks, at = self._places(hashes)
        found = (self.cells[at] == marks[:, None]).any(axis=1)
        return found | (self.cells[self._other(marks, at)] == marks[:, None]).any(axis=1)

    def _settle(self, marks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free cells of their buckets; says which found one."""
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        nth = np.arange(len(at)) - np.searchsorted(sorted_at, sorted_at)
        free = np.argsort(self.cells[sorted_at] != 0, axis=1, kind="stable")
        fits = nth < (self.cells[sorted_at] == 0).sum(axis=1)
        rows = order[fits]
        self.cells[at[rows], free[fits, nth[fits]]] = marks[rows]
        done = np.zeros(len(at), bool)
        done[rows] = True
        return done

    def insert(self, hashes: np.ndarray) -> bool:
        """False on overflow; the filter then has lost a fingerprint and has to be made again from the keys."""
        marks, at = self._places(hashes)
        left = ~self._settle(marks, at)
        marks, at = marks[left], self._other(marks, at)[left]
        draws = np.random.default_rng(len(hashes))
        for _ in range(MAX_ROUNDS):
            left = ~self._settle(marks, at)
            marks, at = marks[left], at[left]
            if not len(marks):
                return True
            # in each full bucket one newcomer takes the place of a fingerprint, which goes to its other bucket
            _, first = np.unique(at, return_index=True)
            slot = draws.integers(0, SLOTS, len(first))
            driven = self.cells[at[first], slot]
            self.cells[at[first], slot] = marks[first]
            marks[first] = driven
            at[first] = self._other(driven, at[first])
        return False

    def delete(self, hashes: np.ndarray) -> None:
        """Takes out one fingerprint for each of the hashes, all of them inserted before."""
        marks, at = self._places(hashes)
        pending = np.arange(len(marks))
        while len(pending):
            gone = np.zeros(len(pending), bool)
            for buckets in (at, self._other(marks, at)):
                m, b = marks[pending], buckets[pending]
                hit = (self.cells[b] == m[:, None]) & ~gone[:, None]
                slot = hit.argmax(axis=1)
                rows = np.flatnonzero(hit.any(axis=1))
                _, first = np.unique(b[rows] * SLOTS + slot[rows], return_index=True)
                rows = rows[first]
                self.cells[b[rows], slot[rows]] = 0
                gone[rows] = True
            if not gone.any():
                raise ValueError("a digest to delete isn't in the filter")
            pending = pending[~gone]


def _hashes(digests: pa.ChunkedArray) -> np.ndarray:
    """The first eight bytes of each digest."""
    joined = b"".join(d[:8] for d in digests.to_pylist())
    return np.frombuffer(joined, "<u8").astype(np.uint64)


def _filter_of(rows: pa.Table) -> CuckooFilter | None:
    if not rows.num_rows:
        return None
    return CuckooFilter(rows.column("buckets")[0].as_py(), rows.column("cells")[0].as_py())


def _row(part: int, made: CuckooFilter | None) -> pa.Table:
    """The row of a part's filter; None where it overflowed."""
    kinds = pa.schema([("part", pa.int32()), ("buckets", pa.int64()), ("cells", pa.binary()), ("overflow", pa.bool_())])
    held = (0, b"", True) if made is None else (made.buckets, made.cells.tobytes(), False)
    return pa.table([[part], *([v] for v in held)], schema=kinds)


class DigestIndex:
    """Live digests with owner and number of rows, in a shared folder.

    ``keys_per_part`` bounds what one task holds of a part when its filter is made again; it and the number of keys to
    come, ``expected``, give the number of parts, which stays for the life of the index.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int, batches: list[str], buckets: int = 0):
        self.spark, self.path, self.parts, self.buckets = spark, path, parts, buckets
        self._batches = batches  # kinds of the batches so far: "insert" or "delete"

    @staticmethod
    def create(spark: SparkSession, path: str | None = None, expected: int = 0, keys_per_part: int = KEYS_PER_PART, buckets: int = 0) -> DigestIndex:
        """An empty index. ``buckets`` is the size of a part's first filter; without it the first batch decides."""
        parts = max(LEAST_PARTS, -(-expected // keys_per_part))
        return DigestIndex(spark, path or shared_folder(spark, "digest-index"), parts, [], buckets)

    @staticmethod
    def open(spark: SparkSession, path: str) -> DigestIndex:
        """The index that a session has left at ``path``."""
        rows = spark.read.json(f"{path}/manifest/*", "seq int, state string").collect()
        state = json.loads(max(rows, key=lambda r: r["seq"])["state"])
        return DigestIndex(spark, path, state["parts"], state["batches"], state["buckets"])

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{len(self._batches)}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _commit(self, kind: str) -> None:
        seq = len(self._batches)
        self._batches.append(kind)
        state = json.dumps({"parts": self.parts, "batches": self._batches, "buckets": self.buckets})
        self.spark.createDataFrame([(seq, state)], "seq int, state string").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/{seq}")

    def _tables(self, kind: str, name: str, columns: str) -> DataFrame:
        paths = [f"{self.path}/{n}/{name}" for n, k in enumerate(self._batches) if k == kind]
        return self.spark.read.schema(columns).parquet(*paths) if paths else self.spark.createDataFrame([], columns)

    def _filters(self) -> DataFrame:
        if not self._batches:
            return self.spark.createDataFrame([], _FILTERS)
        return self.spark.read.schema(_FILTERS).parquet(f"{self.path}/{len(self._batches) - 1}/filters")

    def keys(self) -> DataFrame:
        """The stored keys that live: ``part, digest, owner, size, seq``, one row a digest."""
        keys = self._tables("insert", "keys", _KEYS)
        if "delete" not in self._batches:
            return keys
        gone = self._tables("delete", "gone", "gone_digest binary, gone_seq int")
        return keys.join(gone, (F.col("digest") == F.col("gone_digest")) & (F.col("seq") < F.col("gone_seq")), "left_anti")

    def groups(self) -> DataFrame:
        """``digest, owner, size`` of each live digest: the smallest id inserted with it, and the rows."""
        more = self._tables("insert", "more", "more_digest binary, more_owner long, more_size long, more_seq int")
        keys = self.keys()
        later = (
            keys.join(more, (F.col("digest") == F.col("more_digest")) & (F.col("more_seq") > F.col("seq")))
            .groupBy(F.col("digest").alias("later_digest"))
            .agg(F.min("more_owner").alias("later_owner"), F.sum("more_size").alias("later_size"))
        )
        joined = keys.join(later, F.col("digest") == F.col("later_digest"), "left")
        return joined.select(
            "digest",
            F.least("owner", "later_owner").alias("owner"),
            (F.col("size") + F.coalesce("later_size", F.lit(0))).alias("size"),
        )

    def _probed(self, arrived: DataFrame) -> DataFrame:
        """``arrived`` with ``maybe``: whether its part's filter may hold the digest."""
        names = ["part", "digest", "owner", "size"]

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            held = _filter_of(right)
            maybe = np.zeros(left.num_rows, bool) if held is None else held.may_hold(_hashes(left.column("digest")))
            return left.select(names).append_column("maybe", pa.array(maybe))

        kinds = "part int, digest binary, owner long, size long, maybe boolean"
        return shipped(arrived).groupBy("part").cogroup(self._filters().groupBy("part")).applyInArrow(probe, kinds)

    def _verified(self, probed: DataFrame) -> DataFrame:
        """The digests of ``probed`` that live: those the filters may hold, looked up in the content."""
        held = self.keys().select(F.col("part").alias("key_part"), F.col("digest").alias("key_digest"))
        same = (F.col("part") == F.col("key_part")) & (F.col("digest") == F.col("key_digest"))
        return probed.filter("maybe").join(held, same, "left_semi")

    def insert(self, rows: DataFrame) -> DataFrame:
        """Takes ``(digest, owner, size)`` and gives ``(digest, known)``, one row a digest: whether it lived before.

        Rows that share a digest are summed first, map-side. Null owners never are the smallest; null digests are left out.
        """
        seq = len(self._batches)
        summed = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("owner").alias("owner"), F.sum("size").alias("size"))
        part = F.pmod(F.xxhash64("digest"), F.lit(self.parts)).cast("int")
        arrived = summed.select(part.alias("part"), "digest", F.col("owner").cast("long"), F.col("size").cast("long"))
        probed = self._write(self._probed(arrived), "probed")
        known = self._verified(probed).select(
            F.col("digest").alias("more_digest"), F.col("owner").alias("more_owner"), F.col("size").alias("more_size"), F.lit(seq).alias("more_seq")
        )
        more = self._write(known, "more")
        false_hits = probed.filter("maybe").join(more, F.col("digest") == F.col("more_digest"), "left_anti")
        fresh = probed.filter("NOT maybe").unionAll(false_hits)
        fresh = self._write(fresh.select("part", "digest", "owner", "size", F.lit(seq).alias("seq")), "keys")
        first = self.buckets

        def add(left: pa.Table, right: pa.Table) -> pa.Table:
            held, new = _filter_of(left), right.num_rows
            part = (left if left.num_rows else right).column("part")[0].as_py()
            if held is None:
                held = CuckooFilter(first) if first else CuckooFilter.sized(new)
            fits = new == 0 or held.insert(_hashes(right.column("digest")))
            return _row(part, held if fits else None)

        grown = self._filters().groupBy("part").cogroup(fresh.select("part", "digest").groupBy("part")).applyInArrow(add, _FILTERS)
        filters = self._write(grown, "grown")
        remade = self._remade(filters.filter("overflow"), fresh)
        self._write(filters.filter("NOT overflow").unionAll(remade), "filters")
        self._commit("insert")
        return probed.join(more, F.col("digest") == F.col("more_digest"), "left").select("digest", F.col("more_digest").isNotNull().alias("known"))

    def _remade(self, over: DataFrame, fresh: DataFrame) -> DataFrame:
        """Filters of the parts that overflowed, resized and filled from their stored keys."""
        parts = over.select(F.col("part").alias("over_part"))
        keys = self.keys().select("part", "digest").unionAll(fresh.select("part", "digest"))
        stored = keys.join(parts, F.col("part") == F.col("over_part"), "left_semi")

        def make(rows: pa.Table) -> pa.Table:
            hashes = _hashes(rows.column("digest"))
            return _row(rows.column("part")[0].as_py(), CuckooFilter.of(hashes, 2 * len(hashes)))

        return stored.groupBy("part").applyInArrow(make, _FILTERS)

    def delete(self, digests: DataFrame) -> DataFrame:
        """Takes ``(digest)`` out of the index and gives those that lived. A text inserted later is new again."""
        seq = len(self._batches)
        part = F.pmod(F.xxhash64("digest"), F.lit(self.parts)).cast("int")
        asked = digests.filter("digest IS NOT NULL").select("digest").distinct()
        arrived = asked.select(part.alias("part"), "digest", F.lit(None).cast("long").alias("owner"), F.lit(0).cast("long").alias("size"))
        found = self._verified(self._write(self._probed(arrived), "probed"))
        gone = self._write(found.select(F.col("digest").alias("gone_digest"), F.lit(seq).alias("gone_seq"), "part"), "gone")

        def take(left: pa.Table, right: pa.Table) -> pa.Table:
            held = _filter_of(left)
            if right.num_rows:
                held.delete(_hashes(right.column("gone_digest")))
            return _row(left.column("part")[0].as_py(), held)

        less = self._filters().groupBy("part").cogroup(gone.groupBy("part")).applyInArrow(take, _FILTERS)
        self._write(less, "filters")
        self._commit("delete")
        return gone.select(F.col("gone_digest").alias("digest"))


def normal_digest(text: Column) -> Column:
    """SHA-256 of a text with every run of blanks as one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(stringed(text), r"[\x20\x09-\x0D]+", " "), 256))


def dedup_exact(docs: DataFrame, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text", **index: int) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per row.

    Batches of documents, by rising ranges of doc_id, are inserted one after the other into an empty index.
    The row with the smallest doc_id of equal texts stays. Of rows that share this id and the text one
    stays. A null doc_id comes last: it stays only where no equal text has an id, and keep_id is null then. Null text
    is empty; blanks at the ends count as one space. Empty tables give no rows. ``index`` goes to ``DigestIndex.create``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), normal_digest(F.col(text_col)).alias("digest"))
    # the one pass over the texts; rows that repeat id and text are one row with their number
    rows = scratch.keep(one.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows")))
    bounds = rows.approxQuantile("doc_id", [n / batches for n in range(1, batches)], 0.01) if batches > 1 else []
    edges = sorted({int(b) for b in bounds})
    live = DigestIndex.create(spark, expected=rows.count(), **index)
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        inside = F.lit(True)
        if low is not None:
            inside &= F.col("doc_id") > low
        if high is not None:
            inside &= F.col("doc_id") <= high
        else:
            inside |= F.col("doc_id").isNull()
        live.insert(rows.filter(inside).select("digest", F.col("doc_id").alias("owner"), F.col("rows").alias("size")))
    # written, so that the join below meets two plain tables and AQE may split a hot digest
    groups = scratch.keep(live.groups().withColumnRenamed("digest", "group_digest"))
    joined = rows.join(groups, F.col("digest") == F.col("group_digest"))
    each = joined.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select(
        "doc_id",
        F.col("owner").alias("keep_id"),
        F.col("size").alias("group_size"),
        ((F.col("nth") == 1) & F.col("doc_id").eqNullSafe(F.col("owner"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
