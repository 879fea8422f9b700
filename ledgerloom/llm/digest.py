"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Every byte with each two of the next four makes a triplet; triplets are hashed into 256
buckets and counted. The digest says for each bucket in which quartile of all buckets its count
lies, and holds the text's length on a logarithmic scale. Two digests are compared by the
sum of quartile differences and a length difference, bounded by what unrelated digests show.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, shipped, stringed

BUCKETS = 256
REACH = 4
LENGTH_STEP = 1.1
LENGTH_BOUND = 40
_MULTIPLIER = np.uint32(0x9E3779B1)
_CHUNK = 1 << 20


def bucket_counts(data: bytes) -> np.ndarray:
    """Triplets per bucket, in chunks, so that memory stays bounded for any length."""
    counts = np.zeros(BUCKETS, np.int64)
    for begin in range(0, max(len(data) - 2, 0), _CHUNK):
        part = np.frombuffer(data[begin : begin + _CHUNK + REACH], np.uint8).astype(np.uint32)
        starts = min(_CHUNK, len(data) - begin)
        for kind, (i, j) in enumerate(combinations(range(1, REACH + 1), 2)):
            n = min(starts, len(part) - j)
            if n > 0:
                code = part[:n] | part[i : i + n] << np.uint32(8) | part[j : j + n] << np.uint32(16)
                hashed = ((code | np.uint32(kind << 24)) * _MULTIPLIER) >> np.uint32(24)
                counts += np.bincount(hashed, minlength=BUCKETS)
    return counts


def digest(text: str) -> str:
    """Hex: two digits of length, then two bits for each bucket. Equal texts have equal digests."""
    data = text.encode("utf-8", "surrogatepass")
    counts = bucket_counts(data)
    ordered = np.sort(counts)
    quartiles = sum((counts > ordered[BUCKETS * k // 4 - 1]).astype(np.uint8) for k in (1, 2, 3))
    packed = quartiles[0::4] | quartiles[1::4] << 2 | quartiles[2::4] << 4 | quartiles[3::4] << 6
    length = min(255, round(math.log(len(data) + 1) / math.log(LENGTH_STEP)))
    return f"{length:02x}" + packed.astype(np.uint8).tobytes().hex()


def _quartiles(fingerprint: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(fingerprint[2:]), np.uint8)
    return np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], axis=1).ravel().astype(np.int32)


def difference(a: str, b: str) -> int:
    """Quartile steps apart over all buckets, plus length steps up to LENGTH_BOUND."""
    length = min(LENGTH_BOUND, abs(int(a[:2], 16) - int(b[:2], 16)))
    return int(np.abs(_quartiles(a) - _quartiles(b)).sum()) + length


def likeness(a: str, b: str) -> float:
    """1 for equal digests, down to 0 where the difference reaches that of unrelated ones, 1.25 steps a bucket."""
    return 1.0 - min(1.0, difference(a, b) / (1.25 * BUCKETS + LENGTH_BOUND))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next text's first, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_PAIR = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_COLUMNS = [c.split()[0] for c in _PAIR.split(", ")]


def _compared(doc_id, text: str, mark: str, following: str, next_mark: str) -> tuple:
    mixed = edited(text, following)
    mixed_mark = digest(mixed)
    sha = hashlib.sha256(mixed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, mark, mixed_mark, likeness(mark, mixed_mark), likeness(mark, next_mark)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` for every row; null text is empty."""
    rows = shipped(docs).select(F.col(id_col).alias("doc_id"), stringed(F.col(text_col)).alias("text"))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(digest)

    return rows.select("doc_id", run("text").alias("fingerprint"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how like it the edited and the next text are.

    The next document is the one with the next smaller doc_id; the last is followed by the
    first. Rows that share a doc_id follow each other by their text's hash, then by the text, and null ids come
    last. One document follows itself. Null text is empty.

    One range exchange puts the texts in order and a scan of each partition compares
    neighbours. Only the first and the last text of a partition are written, and the ends of
    neighbouring partitions are joined by partition number.
    """
    scratch = Scratch(docs.sparkSession, "digests")
    rows = shipped(docs).select(F.col(id_col).cast("long").alias("doc_id"), stringed(F.col(text_col)).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    ordered = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    kinds = f"{_PAIR}, part int, edge string, text string"
    names = [c.split()[0] for c in kinds.split(", ")]

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        held = None

        def at_edge(row: tuple, edge: str) -> tuple:
            return (row[0], None, None, row[2], None, None, None, part, edge, row[1])

        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                row = (None if pd.isna(doc_id) else int(doc_id), text, digest(text))
                out.append(at_edge(row, "first") if held is None else (*_compared(*held, *row[1:]), part, None, None))
                held = row
            yield _frame(out, names).astype({"n_chars": "Int64"})
        if held is not None:
            yield _frame([at_edge(held, "last")], names).astype({"n_chars": "Int64"})

    done = scratch.keep(ordered.mapInPandas(scan, kinds))
    lasts = done.filter("edge = 'last'").select("doc_id", "text", "fingerprint", "part")
    firsts = done.filter("edge = 'first'").select(
        F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"), F.col("part").alias("next_part")
    )
    # As many rows as partitions, numbers only.
    parts = done.filter("edge = 'first'").select("part")
    following = parts.select(
        F.col("part").alias("from_part"),
        F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("to_part"),
    )
    meeting = (
        lasts.join(following, F.col("part") == F.col("from_part"))
        .join(firsts, F.col("to_part") == F.col("next_part"))
        .select("doc_id", "text", "fingerprint", "next_text", "next_mark")
    )

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [_compared(None if pd.isna(r[0]) else int(r[0]), *r[1:]) for r in frame.itertuples(index=False, name=None)]
            yield _frame(out, _COLUMNS)

    return done.filter("edge IS NULL").select(*_COLUMNS).unionAll(meeting.mapInPandas(compare, _PAIR))
