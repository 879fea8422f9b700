"""Ranked lexical search over hashed max-sketches.

The index has one sketch a document: two rows of cells, twice a power of two that follows the
number of its distinct terms. Each term is hashed to a cell of either row, and its impact folds into the
cell's maximum. The impact of a term grows with its count alone, as length and weights are the same
for all terms of a cell, so the maxima are kept as counts and stay right while the corpus grows. The
smaller of a term's two cells bounds its impact in the document, and the sum over a query's
terms bounds the score.

A block of queries is looked up in all sketches at once. The documents with the largest bounds are
rescored from their texts; the worst of the best scores is a threshold, and then every further
document whose bound reaches it is rescored, so no document that ranks is missed. Scores are integers
and exact. Equal texts are scored once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, shipped, stringed
from ledgerloom.session import shared_folder

# Terms are runs of ASCII letters and digits and of anything beyond ASCII; only A-Z are lowered.
_SEPARATORS = bytes(b for b in range(128) if not bytes([b]).isalnum())
_TABLE = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))

CELLS_PER_TERM = 4
LEAST_CELLS = 64
MOST = 255  # a cell that says so stands for any larger count
TOP = 10
SEEDS = 32  # documents with the largest bounds that give a query its threshold
BLOCK_TERMS = 50_000  # terms of a block of queries, which is what goes out to the tasks at once
_ROWS = 512
_NO_ID = -(1 << 63)
_DFS = 200_000

_INDEX = "term string, df long, doc_id long, key long, n long, cells int, sketch binary"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def term_hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term, 7)


def sketch(counts: dict[bytes, int], hashes: dict[bytes, int]) -> tuple[int, bytes]:
    """Cells a row, and both rows. ``hashes`` remembers what was hashed before."""
    cells = LEAST_CELLS
    while cells < CELLS_PER_TERM * len(counts):
        cells *= 2
    rows = np.zeros((2, cells), np.uint8)
    if counts:
        for term in counts:
            if term not in hashes:
                hashes[term] = term_hash(term)
        at = np.fromiter(map(hashes.__getitem__, counts), np.uint64, len(counts))
        tf = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), MOST).astype(np.uint8)
        for row, shift in enumerate((0, 32)):
            np.maximum.at(rows[row], (at >> np.uint64(shift) & np.uint64(cells - 1)).astype(np.int64), tf)
    return cells, rows.tobytes()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def length_factor(n: int, documents: int, length: int) -> int:
    return 100 - 75 + (75 * n * documents) // length


def impact(tf: int, m: int) -> int:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = stringed(F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))


class Block:
    """What the tasks need of a block of queries: its terms, their weights, and the queries as lists of terms."""

    def __init__(self, rows: list[tuple[int, bytes, int, int]], documents: int, length: int):
        """``rows``: query, term, times, weight; weight 0 adds nothing and is left out."""
        rows = [r for r in rows if r[3] > 0]
        self.documents, self.length = documents, length
        self.terms = sorted({r[1] for r in rows})
        number = {t: i for i, t in enumerate(self.terms)}
        self.queries: dict[int, list[tuple[int, int]]] = {}
        for query, term, times, w in rows:
            self.queries.setdefault(query, []).append((number[term], times * w))
        hashes = np.array([term_hash(t) for t in self.terms], np.uint64)
        self.at = [(hashes >> np.uint64(s)) & np.uint64(0xFFFFFFFF) for s in (0, 32)]
        self.names = sorted(self.queries)
        # float32 sums of so many terms lose less than this
        self._margin = np.array([1 + 1e-4 + 2e-7 * len(self.queries[q]) for q in self.names])[:, None]
        self._lists = [(np.array([t for t, _ in self.queries[q]]), np.array([w for _, w in self.queries[q]], np.float32)) for q in self.names]

    def bounds(self, cells: int, sketches: list[bytes], n: np.ndarray) -> np.ndarray:
        """Upper bounds of all queries (rows) for documents with sketches of one width."""
        held = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), 2, cells)
        tf = None
        for row in range(2):
            across = np.ascontiguousarray(held[:, row, :].T)
            got = across[(self.at[row] & np.uint64(cells - 1)).astype(np.int64)]
            tf = got if tf is None else np.minimum(tf, got)
        m = (25 + (75 * n * self.documents) // max(self.length, 1)).astype(np.float32)
        counts = np.where(tf == MOST, np.float32(1e12), tf.astype(np.float32))
        impacts = np.float32(1e9) * counts / (1000 * counts + 8 * m)
        out = np.stack([w @ impacts[t] for t, w in self._lists])
        return out.astype(np.float64) * self._margin + 1

    def score(self, counts: dict[bytes, int], n: int, wanted: list[int]) -> list[int]:
        """Exact scores of one document for some of the queries."""
        m = length_factor(n, self.documents, self.length)
        known: dict[int, int] = {}
        out = []
        for query in wanted:
            total = 0
            for t, w in self.queries[query]:
                if t not in known:
                    tf = counts.get(self.terms[t], 0)
                    known[t] = impact(tf, m) if tf else 0
                total += w * known[t]
            out.append(total)
        return out


class MaxSketchIndex:
    """Sketches and document frequencies of a corpus, in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.table = spark.read.schema(_INDEX).parquet(path)

    @staticmethod
    def build(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> MaxSketchIndex:
        """One pass over the texts; a task writes a sketch for each document, and counts by term."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes: dict[bytes, int] = {}
            dfs: Counter[bytes] = Counter()
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            names = ["term", "df", "doc_id", "key", "n", "cells", "sketch"]

            def frequencies() -> pa.RecordBatch:
                count = len(dfs)
                term = pa.array([t.decode("utf-8", "replace") for t in dfs], pa.string())
                rest = [pa.nulls(count, k) for k in kinds[2:]]
                made = pa.RecordBatch.from_arrays([term, pa.array(dfs.values(), pa.int64()), *rest], names)
                dfs.clear()
                return made

            for batch in batches:
                for begin in range(0, len(batch), _ROWS):
                    part = batch.slice(begin, _ROWS)
                    sizes, widths, sketches = [], [], []
                    for text in part.column(2):
                        found = terms_of(text.as_py())
                        counts = Counter(found)
                        dfs.update(counts.keys())
                        cells, made = sketch(counts, hashes)
                        sizes.append(len(found))
                        widths.append(cells)
                        sketches.append(made)
                    columns = [pa.nulls(len(part), k) for k in kinds[:2]]
                    columns += [part.column(0), part.column(1), pa.array(sizes, kinds[4]), pa.array(widths, kinds[5]), pa.array(sketches, kinds[6])]
                    yield pa.RecordBatch.from_arrays(columns, names)
                    if len(dfs) > _DFS:
                        yield frequencies()
                    if len(hashes) > 4 * _DFS:
                        hashes.clear()
            if dfs:
                yield frequencies()

        path = path or shared_folder(docs.sparkSession, "max-sketches")
        shipped(docs)
        _keyed(docs, id_col, text_col).mapInArrow(run, _INDEX).write.mode("overwrite").parquet(path)
        return MaxSketchIndex(docs.sparkSession, path)

    def _sketches(self) -> DataFrame:
        return self.table.filter("sketch IS NOT NULL").select("doc_id", "key", "n", "cells", "sketch")

    def search(
        self, docs: DataFrame, queries: DataFrame, top: int = TOP, item_col: str = "item_id", query_col: str = "text", id_col: str = "doc_id", text_col: str = "text"
    ) -> DataFrame:
        """``item_id, rank, doc_id, score``: the ``top`` best of ``docs``, the indexed table, for each query, where above 0.

        Equal scores go by doc_id, rows without one last; repeated rows rank one by one. Queries without terms that a document
        holds, null and empty ones, give no rows, as do empty tables. Rows that share an item_id
        are one query with the terms of all. Blocks of queries are searched one after the other, each written.
        """
        scratch = Scratch(self.spark, "lexical")
        asked = scratch.keep(_query_terms(queries, item_col, query_col))
        totals = self._sketches().agg(F.sum(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        documents, length = totals[0] or 0, totals[1] or 0
        # document frequencies of the queries' terms alone
        df = self.table.filter("term IS NOT NULL").select("term", "df")
        mine = asked.select(F.col("term").alias("asked_term")).distinct()
        found = df.join(mine, F.col("term") == F.col("asked_term"), "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        weighed = scratch.keep(asked.join(found, "term").select("item_id", "term", "times", "df"))
        blocks = -(-weighed.count() // BLOCK_TERMS)
        item_block = F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1)))
        out = None
        for number in range(blocks):
            # a block's terms, some BLOCK_TERMS, and no document's
            rows = weighed.filter(item_block == number).collect()
            items = sorted({r.item_id for r in rows}, key=lambda i: (i is None, i))
            place = {item: k for k, item in enumerate(items)}
            block = Block([(place[r.item_id], r.term.encode(), r.times, weight(documents, r.df)) for r in rows], documents, length)
            if not block.terms:
                continue
            ranked = scratch.keep(self._ranked(_keyed(docs, id_col, text_col), block, top, scratch))
            kind = weighed.schema["item_id"].dataType
            named = self.spark.createDataFrame(list(enumerate(items)), f"number int, item_id {kind.simpleString()}")
            done = ranked.join(named, F.col("query") == F.col("number")).select("item_id", "rank", "doc_id", "score")
            out = done if out is None else out.unionAll(done)
        if out is None:
            kind = weighed.schema["item_id"].dataType.simpleString()
            return self.spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
        return out

    def _bounded(self, block: Block, thresholds: list[float] | None, most: int) -> DataFrame:
        """``(query, key, doc_id, bound)``: of each task the ``most`` largest bounds a query, or all from its threshold on."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = np.array(block.names)
            floor = np.zeros(len(names)) if thresholds is None else np.array(thresholds)
            best: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]

            def rows(held: tuple[np.ndarray, ...], ids: pa.Array) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(held[0], pa.int32()), pa.array(held[1]), ids, pa.array(held[3])], ["query", "key", "doc_id", "bound"])

            def pruned() -> tuple[np.ndarray, ...]:
                """The largest bounds of each query, a text once."""
                held = tuple(np.concatenate(x) for x in zip(*best, strict=True))
                order = np.lexsort((held[2], held[1], -held[3], held[0]))
                held = tuple(x[order] for x in held)
                first = np.ones(len(held[0]), bool)
                first[1:] = (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])
                held = tuple(x[first] for x in held)
                nth = np.arange(len(held[0])) - np.searchsorted(held[0], held[0])
                return tuple(x[nth < most] for x in held)

            for batch in batches:
                widths = batch.column(3).to_numpy()
                for cells in np.unique(widths).tolist():
                    chosen = np.flatnonzero(widths == cells)
                    step = max(1, min(_ROWS, (1 << 24) // cells, (1 << 22) // len(block.terms)))
                    for begin in range(0, len(chosen), step):
                        part = batch.take(pa.array(chosen[begin : begin + step]))
                        n, keys = part.column(2).to_numpy(), part.column(1).to_numpy()
                        bounds = block.bounds(cells, part.column(4).to_pylist(), n)
                        bounds[:, n == 0] = 0
                        if thresholds is None:
                            _, once = np.unique(keys, return_index=True)
                            few = bounds[:, once]
                            if most < few.shape[1]:
                                at = np.argpartition(-few, most, axis=1)[:, :most]
                            else:
                                at = np.broadcast_to(np.arange(few.shape[1]), few.shape)
                            row = np.broadcast_to(np.arange(len(names))[:, None], at.shape)
                            good = few[row, at] > np.maximum(floor, 1.5)[:, None]
                            ids = pc.fill_null(part.column(0), _NO_ID).to_numpy()
                            best.append((names[row[good]], keys[once[at[good]]], ids[once[at[good]]], few[row[good], at[good]]))
                            if sum(len(b[0]) for b in best) > 4 * most * len(names):
                                best[:] = [pruned()]
                                count = np.bincount(np.searchsorted(names, best[0][0]), minlength=len(names))
                                last = np.full(len(names), np.inf)
                                np.minimum.at(last, np.searchsorted(names, best[0][0]), best[0][3])
                                floor = np.where(count >= most, last, floor)
                        else:
                            row, at = np.nonzero((bounds >= floor[:, None]) & (bounds > 1.5))
                            if len(row):
                                yield rows((names[row], keys[at], None, bounds[row, at]), part.column(0).take(pa.array(at)))
            if thresholds is None:
                held = pruned()
                yield rows(held, pa.array(held[2]))

        return shipped(self._sketches()).mapInArrow(run, "query int, key long, doc_id long, bound double")

    def _scored(self, docs: DataFrame, pairs: DataFrame, block: Block) -> DataFrame:
        """``(query, key, score)`` of ``(query, key, doc_id)``, from the text of the row with this id and key."""
        wanted = pairs.groupBy(F.col("key").alias("want_key"), F.col("doc_id").alias("want_id")).agg(F.collect_set("query").alias("queries"))
        same = (F.col("key") == F.col("want_key")) & F.col("doc_id").eqNullSafe(F.col("want_id"))
        texts = docs.join(wanted, same).select("key", "text", "queries")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple[int, int, int]] = []
                for key, text, queries in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                    found = terms_of(text.as_py())
                    out += [(q, key, s) for q, s in zip(queries, block.score(Counter(found), len(found), queries), strict=True)]
                columns = zip(*out, strict=True) if out else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["query", "key", "score"])

        scored = texts.mapInArrow(run, "query int, key long, score long")
        return scored.groupBy("query", "key").agg(F.max("score").alias("score"))

    def _ranked(self, docs: DataFrame, block: Block, top: int, scratch: Scratch) -> DataFrame:
        """``(query, rank, doc_id, score)`` of a block's queries."""
        seeds = max(SEEDS, top)
        seen = self._bounded(block, None, seeds).groupBy("query", "key").agg(F.max("bound").alias("bound"), F.max("doc_id").alias("doc_id"))
        by_bound = Window.partitionBy("query").orderBy(F.col("bound").desc(), "key")
        first = seen.withColumn("nth", F.row_number().over(by_bound)).filter(F.col("nth") <= seeds)
        # rows without an id are looked up as such
        first = first.select("query", "key", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"))
        scores = scratch.keep(self._scored(docs, scratch.keep(first), block))
        by_score = Window.partitionBy("query").orderBy(F.col("score").desc(), "key")
        worst = scores.withColumn("nth", F.row_number().over(by_score)).filter(F.col("nth") == top).select("query", "score").collect()
        level = {r.query: float(r.score) for r in worst}
        # every document from the threshold on; of equal texts no more than the first few can rank
        near = self._bounded(block, [level.get(q, 0.0) for q in block.names], 0)
        of_text = Window.partitionBy("query", "key").orderBy(F.col("doc_id").asc_nulls_last())
        members = scratch.keep(near.withColumn("nth", F.row_number().over(of_text)).filter(F.col("nth") <= top).select("query", "key", "doc_id", "nth"))
        known = scores.select(F.col("query").alias("known_query"), F.col("key").alias("known_key"))
        same = (F.col("query") == F.col("known_query")) & (F.col("key") == F.col("known_key"))
        rest = members.filter("nth = 1").join(known, same, "left_anti")
        more = scratch.keep(self._scored(docs, rest, block))
        both = scores.unionAll(more).filter("score > 0").select(F.col("query").alias("of"), F.col("key").alias("of_key"), "score")
        placed = members.join(both, (F.col("query") == F.col("of")) & (F.col("key") == F.col("of_key")))
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "key")
        ranked = placed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        return ranked.select("query", "rank", "doc_id", "score")


def _query_terms(queries: DataFrame, item_col: str, query_col: str) -> DataFrame:
    """``(item_id, term, times)`` of all queries."""
    rows = queries.select(F.col(item_col).alias("item_id"), stringed(F.col(query_col)).alias("text"))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    term = F.explode(F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
    return rows.select("item_id", term.alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))
