"""SimHash near-duplicates: anchor-point covering finds all fingerprint pairs within a bit distance.

A fingerprint's 64 bits are covered by two blocks of 23 bits, each with the perfect binary
Golay code (covering radius 3), so an anchor is a pair of code words and 2**24 anchors cover
everything. Every fingerprint has one home, the anchor within the radius in both blocks, and
visits every anchor within the covering radius plus the threshold, the threshold being shared
between the blocks. If two fingerprints differ in at most the threshold, the second visits the
home of the first: moving it onto the first changes the distance to that home by no more than
the bits in which they differ. So homes meet visitors anchor by anchor and no link is lost. The
18 bits outside the blocks count in the comparison only.

With a threshold of 2 there are 61 visits for each distinct fingerprint on average, whatever the
number of documents. Copies share a fingerprint and are one row from the start, and a
fingerprint has at most 2,080 neighbours, so no group emits all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, shipped

SHINGLE_WORDS = 3
MAX_BITS = 2

# Fixed values of the binary Golay code: length, radius, and the generator x^11+x^9+x^7+x^6+x^5+x+1.
CODE_BITS = 23
CODE_RADIUS = 3
CODE_GENERATOR = 0b101011100011
BLOCK_SHIFTS = (0, 23)

# Upper-case ASCII letters to lower case, all other bytes as they are.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

_hash = partial(xxhash.xxh64_intdigest, seed=42)
_CHUNK = 1 << 16


def simhash(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one text, in chunks of shingles, so memory stays bounded for any length."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        total = 1
    else:
        grams = map(b" ".join, zip(*(islice(words, i, None) for i in range(shingle)), strict=False))
        total = len(words) - shingle + 1
    votes = np.zeros(64, np.int64)
    hashes = map(_hash, grams)
    for begin in range(0, total, _CHUNK):
        part = np.fromiter(hashes, np.uint64, min(_CHUNK, total - begin))
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` holds the 64 bits as a signed long. Null text counts as empty."""
    source = shipped(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array((_signed(simhash(t.as_py(), shingle)) for t in batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return source.mapInArrow(run, "doc_id long, fp long")


@lru_cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainders by the generator of all low 12-bit and all high 11-bit halves of a block."""
    bit = []
    for i in range(CODE_BITS):
        rest = 1 << i
        for j in range(i, 10, -1):
            if rest >> j & 1:
                rest ^= CODE_GENERATOR << (j - 11)
        bit.append(rest)
    tables = []
    for first, width in ((0, 12), (12, 11)):
        out = np.zeros(1 << width, np.int64)
        for i in range(width):
            out[1 << i : 2 << i] = out[: 1 << i] ^ bit[first + i]
        tables.append(out)
    return tables[0], tables[1]


def syndrome(words: np.ndarray) -> np.ndarray:
    low, high = _syndromes()
    return low[words & 0xFFF] ^ high[words >> 12]


@lru_cache
def _flips(excess: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit patterns that lead to a code word at the radius plus ``excess`` (0: within the radius), by syndrome."""
    weights = range(CODE_RADIUS + 1) if excess == 0 else [CODE_RADIUS + excess]
    made = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(CODE_BITS), w)], np.int64)
    kinds = syndrome(made)
    order = np.argsort(kinds, kind="stable")
    return made[order], np.searchsorted(kinds[order], np.arange(2049))


def anchors(fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors of all visits: block distances above the radius sum to ``reach`` at most."""
    fps = fps.astype(np.int64).view(np.uint64)
    visits = [(np.arange(len(fps)), np.zeros(len(fps), np.int64), 0)]
    for shift in BLOCK_SHIFTS:
        words = ((fps >> np.uint64(shift)) & np.uint64((1 << CODE_BITS) - 1)).astype(np.int64)
        kinds = syndrome(words)
        further = []
        for rows, anchor, spent in visits:
            for excess in range(reach - spent + 1):
                flips, starts = _flips(excess)
                kind = kinds[rows]
                counts = starts[kind + 1] - starts[kind]
                again = np.repeat(np.arange(len(rows)), counts)
                inside = np.arange(len(again)) - np.repeat(np.cumsum(counts) - counts, counts)
                code = words[rows[again]] ^ flips[starts[kind][again] + inside]
                further.append((rows[again], anchor[again] | code << shift, spent + excess))
        visits = further
    return np.concatenate([v[0] for v in visits]), np.concatenate([v[1] for v in visits])


def _visits(fps: DataFrame, reach: int, name: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin in range(0, len(frame), 4096):
                part = frame["fp"].to_numpy()[begin : begin + 4096]
                rows, anchor = anchors(part, reach)
                yield pd.DataFrame({"anchor": anchor, name: part[rows]})

    return shipped(fps).select("fp").mapInPandas(run, f"anchor long, {name} long")


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)``: every pair of distinct fingerprints at most ``max_bits`` apart, once. ``fps.fp`` is unique.

    Spark sizes the visits like the fingerprints that make them, some 61 times too low, so they are always
    sorted and merged: a broadcast of them could fill the driver.
    """
    homes, visitors = _visits(fps, 0, "a").hint("merge"), _visits(fps, max_bits, "b").hint("merge")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    joined = homes.join(
        visitors.withColumnRenamed("anchor", "visited"),
        (F.col("anchor") == F.col("visited")) & (F.col("a") < F.col("b")) & near,
    )
    return joined.select("a", "b")


def components(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, label)`` of linked nodes, written; the label is the smallest node of the component.

    Each round lowers a node's label to the smallest among its neighbours, hooks the old
    label's own node onto it and halves the paths by one jump, so long chains take a
    logarithmic number of rounds. Labels are written in each round; none comes to the driver.
    """
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = scratch.keep(both)
    labels = scratch.keep(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("lower"))
        seen = scratch.keep(labels.join(near, F.col("node") == F.col("a")).select("node", "label", "lower"))
        hooks = seen.groupBy(F.col("label").alias("hooked")).agg(F.min("lower").alias("hook"))
        hooked = scratch.keep(
            seen.join(hooks, F.col("node") == F.col("hooked"), "left").select(
                "node", F.col("label").alias("old"), F.least("label", "lower", "hook").alias("label")
            )
        )
        up = hooked.select(F.col("node").alias("via"), F.col("label").alias("above"))
        jumped = scratch.keep(
            hooked.join(up, F.col("label") == F.col("via")).select("node", "old", F.least("label", "above").alias("label"))
        )
        moved = not jumped.filter(F.col("old") != F.col("label")).isEmpty()
        scratch.drop(labels, seen, hooked)
        labels = jumped
        if not moved:
            scratch.drop(edges)
            return labels


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id, component_fp``.

    Fingerprints within ``max_bits`` are linked and ``component_id`` is the smallest doc_id
    that is reachable. Texts without words (null, empty, blank) have fingerprint 0 and are
    linked like any other. Repeated rows stay rows of their own. A null doc_id is in its
    component but never names it; a component of such rows alone has a null component_id.
    ``component_fp`` tells components apart also then. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, shingle, id_col, text_col))
    classes = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes, max_bits), scratch)
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("root")
    )
    firsts = rooted.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("component_id"))
    # Written, so that the join below meets two plain tables and AQE may split a hot fingerprint.
    named = scratch.keep(
        rooted.join(firsts, F.col("root") == F.col("of")).select(F.col("fp").alias("class_fp"), "root", "component_id")
    )
    scratch.drop(classes, roots)
    return fps.join(named, F.col("fp") == F.col("class_fp")).select(
        "doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id", hexed(F.col("root")).alias("component_fp")
    )


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(
    docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of ``docs``, all columns, of each component: of the rows whose doc_id names it, the first by text.

    Rows that repeat a doc_id are judged by their own component each. Of a component without any
    doc_id the first row by text stays (null first; equal rows are alike). Null texts have fingerprint 0 like empty
    ones. An empty table stays empty; other columns of any name are carried along.
    """
    found = near_duplicates(docs, shingle, max_bits, id_col, text_col)
    scratch = Scratch(docs.sparkSession, "simhash-kept")
    names = F.max(F.col("doc_id") == F.col("component_id"))
    kept = scratch.keep(
        found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), names.alias("names")).filter("names OR doc_id IS NULL")
    )
    # The ids grow with the documents, so both sides are always sorted and merged: a broadcast that fits a
    # small corpus is another plan than the one that a large corpus gets.
    once = kept.filter("rows = 1").select(F.col("doc_id").alias("kept_id")).hint("merge")
    out = docs.join(once, docs[id_col] == once["kept_id"], "left_semi")
    if not kept.filter("rows > 1 OR doc_id IS NULL").isEmpty():
        more = kept.filter("rows > 1").select(F.col("doc_id").alias("kept_id")).hint("merge")
        unclear = docs.join(more, docs[id_col] == more["kept_id"], "left_semi").unionAll(docs.filter(F.col(id_col).isNull()))
        out = out.unionAll(_one_of_each(unclear, found, shingle, id_col, text_col))
    return out


def _one_of_each(rows: DataFrame, found: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """Of rows that a doc_id doesn't tell apart, those that stay; their fingerprints lead to their components."""

    @F.pandas_udf("long")
    def fp_of(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(simhash(t, shingle)) for t in texts], dtype="int64")

    text = F.col(text_col).cast("string")
    keyed = rows.select(
        F.struct(*rows.columns).alias("row"),
        F.col(id_col).cast("long").alias("row_id"),
        text.alias("row_text"),
        hexed(fp_of(text.cast("binary"))).alias("row_fp"),
    )
    classes = found.select("fingerprint", "component_id", "component_fp").distinct()
    placed = keyed.join(classes.hint("merge"), F.col("row_fp") == F.col("fingerprint"))
    by = Window.partitionBy("component_fp").orderBy(F.col("row_text").asc_nulls_first())
    firsts = placed.filter(F.col("row_id").eqNullSafe(F.col("component_id"))).withColumn("nth", F.row_number().over(by)).filter("nth = 1")
    return firsts.select("row.*")
