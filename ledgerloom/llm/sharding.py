"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level every child draws ``-ln(u) / weight`` with ``u`` a hash of the document and the
child, and the least draw wins. A draw depends on the child's own name and weight only, so if the
weight of a subtree changes, documents move into it or out of it and none moves between two
other children of the same node. A tree grows by a region of its own, so that one more shard takes
documents into itself alone.

The descent is a column of array draws over numpy inside tasks. Slots are dense per shard without
a task that holds a shard: rows are ranked in small hash buckets of the shard and the buckets'
counts give the offsets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, shipped

SHARDS = 16
REGION_RACKS, RACK_SHARDS = 2, 4
SLOT_BUCKETS = 1 << 12


@dataclass
class Node:
    """A region, a rack or a shard; only shards have a number, inner nodes weigh what their children weigh."""

    name: str
    children: list[Node] = field(default_factory=list)
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(shards: int = SHARDS, racks: int = REGION_RACKS, per_rack: int = RACK_SHARDS, weights: dict[int, float] | None = None) -> Node:
    """Full regions of ``racks * per_rack`` shards; each shard beyond the last full region is a region of its own."""
    weights, size = weights or {}, racks * per_rack

    def leaf(n: int) -> Node:
        return Node(f"shard{n}", [], n, weights.get(n, 1.0))

    regions = []
    for r in range(shards // size):
        first = r * size
        regions.append(
            Node(
                f"region{r}",
                [Node(f"rack{r}.{k}", [leaf(first + k * per_rack + i) for i in range(per_rack)]) for k in range(racks)],
            )
        )
    for n in range(shards // size * size, shards):
        regions.append(grown_region(n, weights.get(n, 1.0)))
    return Node("root", regions)


def grown_region(shard: int, weight: float = 1.0) -> Node:
    return Node(f"region+{shard}", [Node(f"rack+{shard}", [Node(f"shard{shard}", [], shard, weight)])])


def grown(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one shard more, in a region of its own."""
    return Node(root.name, [*root.children, grown_region(shard, weight)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _name_hash(name: str) -> np.uint64:
    out = np.zeros(1, np.uint64)
    for byte in name.encode():
        out = _mixed(out + np.uint64(byte + 1))
    return out[0]


def descend(keys: np.ndarray, root: Node) -> np.ndarray:
    """Shard numbers of 64-bit keys."""
    keys = keys.astype(np.int64).view(np.uint64)
    out = np.full(len(keys), -1, np.int32)

    def walk(node: Node, rows: np.ndarray) -> None:
        if not node.children:
            out[rows] = node.shard
            return
        best, chosen = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)
        for n, child in enumerate(node.children):
            if child.weight <= 0:
                continue
            u = ((_mixed(keys[rows] ^ _name_hash(child.name)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            draw = -np.log(u) / child.weight
            better = draw < best
            best, chosen = np.where(better, draw, best), np.where(better, n, chosen)
        for n, child in enumerate(node.children):
            if len(part := rows[chosen == n]):
                walk(child, part)

    walk(root, np.arange(len(keys)))
    return out


def shard_of(key: Column, root: Node) -> Column:
    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(descend(batch.to_numpy(), root))

    return run(key)


def assign(
    docs: DataFrame,
    shards: int = SHARDS,
    weights: dict[int, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row per row.

    The law is ``key``: the doc_id and the tree decide, so rows that repeat a doc_id share a
    shard and rows without one share another. ``size`` is the text's UTF-8 bytes plus 1 and
    ``text_crc32`` its checksum (null text: 1 and 0). ``slot`` runs from 0 without gaps in each shard;
    equal rows are alike, so their order among themselves doesn't matter.
    """
    root = tree(shards, weights=weights)
    key = F.xxhash64(F.col("doc_id"))
    raw = shipped(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    placed = raw.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, root).alias("shard"),
        shard_of(key, grown(root, shards)).alias("grown_shard"),
    )
    scratch = Scratch(docs.sparkSession, "shards")
    return slotted(scratch.keep(placed), ["shard"], ["doc_id", "text_crc32", "size"])


def slotted(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``slot``, dense from 0 per group, by hash bucket and then by ``order``.

    ``rows`` is a written table: it is read for the counts and again for the ranks.
    """
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(SLOT_BUCKETS)).cast("int"))
    counts = bucketed.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("filled"))
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "bucket", F.coalesce(F.sum("filled").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy(*group, "bucket").orderBy(*order))
    return (
        bucketed.withColumn("rank", rank)
        .join(offsets, [*group, "bucket"])
        .withColumn("slot", (F.col("offset") + F.col("rank") - 1).cast("long"))
        .drop("bucket", "rank", "offset")
    )
