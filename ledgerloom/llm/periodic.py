"""Periodic runs of words, found online by dyadic square catchers.

A text grows word by word. A square of period p that ends here is a stretch of p words each equal
to the word p before it. Level k watches the periods from 2 * L - 1 to 4 * L - 2 for L = 2**k; such a
stretch holds a whole block of L words that starts at a multiple of L. So, as soon as a block is
complete, its catchers are the periods of its level at which the same block stands before it.
A catcher follows its stretch to the left once and to the right as words are appended, by suffix
comparisons over doubling widths. When the stretch reaches p words it reports a square; as
it goes on the squares merge into one repetition. Repetitions with the same ends are one run
with the smallest of their periods.

Blocks are compared by 64-bit hashes that are combined pair by pair, so comparisons and catchers of
one append are array operations: n log n of them for n words, n log(n)**2 for the worst of texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import shipped

# What counts as a run by default: so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

# Words of one append; longer texts come in several.
APPEND = 1 << 16
_FIRST, _SECOND, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two halves; order counts and the step isn't linear."""
    out = a * _FIRST ^ (b + _SECOND) * _MIX
    out ^= out >> _SHIFT
    out *= _MIX
    out ^= out >> _SHIFT
    return out


class SquareCatchers:
    """The catchers of one growing text of word numbers."""

    def __init__(self) -> None:
        self.size = 0
        self._hashes: list[np.ndarray] = []  # by level: the hash of the 2**level words from each position
        self._filled: list[int] = []
        self._active: list[tuple[np.ndarray, np.ndarray]] = []  # by level: periods and starts of stretches that reach the end
        self._found: list[np.ndarray] = []  # rows (start, end, period)

    def append(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """Takes further words. Gives a square ``(start, end, period)`` for each repetition that became one just now: its first."""
        before = self.size
        self.size += len(words)
        self._hash(words)
        caught = []
        for level in range(len(self._hashes)):
            if 3 << level > self.size + 1:
                break
            periods, starts, ends = self._follow(level, before)
            if not len(periods):
                continue
            known = ends - starts >= periods
            for p, s in zip(periods[known].tolist(), starts[known].tolist(), strict=True):
                if before - s < p:
                    caught.append((s - p, s + p, p))
            rows = np.stack([starts - periods, ends, periods], axis=1)
            going = ends == self.size
            self._active[level] = (periods[going], starts[going])
            self._found.append(rows[known & ~going])
        return caught

    def runs(self, least_words: int = 2, least_periods: int = 2) -> np.ndarray:
        """Rows ``(start, end, period)`` of the runs so far, by start, then period."""
        rows = [*self._found]
        for periods, starts in self._active:
            if not len(periods):
                continue
            going = self.size - starts >= periods
            rows.append(np.stack([starts - periods, np.full(len(starts), self.size), periods], axis=1)[going])
        if not any(map(len, rows)):
            return np.zeros((0, 3), np.int64)
        all_rows = np.concatenate(rows)
        # the smallest period of each stretch
        all_rows = all_rows[np.lexsort((all_rows[:, 2], all_rows[:, 1], all_rows[:, 0]))]
        first = np.ones(len(all_rows), bool)
        first[1:] = (all_rows[1:, :2] != all_rows[:-1, :2]).any(axis=1)
        out = all_rows[first]
        length = out[:, 1] - out[:, 0]
        out = out[(length >= least_words) & (length >= least_periods * out[:, 2])]
        return out[np.lexsort((out[:, 2], out[:, 0]))]

    def _room(self, level: int, count: int) -> np.ndarray:
        """The level's array with place for ``count`` hashes, its size doubled where needed."""
        if level == len(self._hashes):
            self._hashes.append(np.zeros(count, np.uint64))
            self._filled.append(0)
            self._active.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
        held = self._hashes[level]
        if len(held) < count:
            self._hashes[level] = np.concatenate([held, np.zeros(max(count - len(held), len(held)), np.uint64)])
        return self._hashes[level]

    def _hash(self, words: np.ndarray) -> None:
        """Hashes of all stretches of 2**level words that are complete now, for the levels with a block that has one of its periods before it."""
        first = self._room(0, self.size)
        first[self.size - len(words) : self.size] = _mixed(words.astype(np.uint64), words.astype(np.uint64))
        self._filled[0] = self.size
        level = 1
        while (count := self.size - (1 << level) + 1) >= 2 << level:
            below, half = self._hashes[level - 1], 1 << (level - 1)
            here = self._room(level, count)
            begin = self._filled[level]
            here[begin:count] = _mixed(below[begin:count], below[begin + half : count + half])
            self._filled[level] = count
            level += 1

    def _follow(self, level: int, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Periods, starts and ends of the level's stretches that reach the words after ``before``."""
        old_periods, old_starts = self._active[level]
        periods, starts, ends = self._new(level, before)
        if not len(old_periods):
            return periods, self._left(starts, periods, level), self._right(ends, periods, level)
        old_ends = self._right(np.full(len(old_starts), before), old_periods, len(self._hashes) - 1)
        if len(periods):
            # a block inside a stretch that is followed already belongs to its catcher
            reach = dict(zip(old_periods.tolist(), old_ends.tolist(), strict=True))
            fresh = np.array([s >= reach.get(p, 0) for p, s in zip(periods.tolist(), starts.tolist(), strict=True)], bool)
            periods, starts, ends = periods[fresh], starts[fresh], ends[fresh]
        starts = self._left(starts, periods, level)
        ends = self._right(ends, periods, level)
        return np.concatenate([old_periods, periods]), np.concatenate([old_starts, starts]), np.concatenate([old_ends, ends])

    def _new(self, level: int, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of whole blocks completed after ``before`` that stand one of the level's periods earlier too."""
        width = 1 << level
        none = np.zeros(0, np.int64)
        first, last = before // width, self.size // width
        if first >= last:
            return none, none, none
        hashes = self._hashes[level]
        starts = np.arange(first, last) * width
        # periods 2L-1 .. 4L-2 stand for the positions start-4L+2 .. start-2L+1
        low = int(starts[0]) - 4 * width + 2
        pad = max(0, -low)
        window = hashes[max(low, 0) : int(starts[-1]) - 2 * width + 2] if starts[-1] - 2 * width + 2 > 0 else hashes[:0]
        if not len(window):
            return none, none, none
        padded = np.concatenate([np.zeros(pad, np.uint64), window]) if pad else np.ascontiguousarray(window)
        step = padded.strides[0]
        there = np.ndarray((len(starts), 2 * width), np.uint64, padded, strides=(step * width, step))
        same = there == hashes[starts][:, None]
        if not same.any():
            return none, none, none
        if pad:
            at_front = np.arange(2 * width)[None, :] + starts[: pad // width + 1, None] - 4 * width + 2 < 0
            same[: len(at_front)][at_front[: len(same)]] = False
        # by period, then block; blocks that follow each other are one stretch
        column, block = np.nonzero(same.T)
        if not len(block):
            return none, none, none
        begins = np.ones(len(block), bool)
        begins[1:] = (column[1:] != column[:-1]) | (block[1:] != block[:-1] + 1)
        heads = np.flatnonzero(begins)
        tails = np.append(heads[1:], len(block)) - 1
        return 4 * width - 2 - column[heads], starts[block[heads]], starts[block[tails]] + width

    def _left(self, starts: np.ndarray, periods: np.ndarray, level: int) -> np.ndarray:
        """Starts moved left over equal words; fewer than a block's words are equal before a whole block that isn't."""
        starts = starts.copy()
        for step in range(level - 1, -1, -1) if len(starts) else ():
            width, hashes = 1 << step, self._hashes[step]
            at = starts - width
            fits = at >= periods
            at = np.where(fits, at, periods)
            starts -= width * (fits & (hashes[at] == hashes[at - periods]))
        return starts

    def _right(self, ends: np.ndarray, periods: np.ndarray, level: int) -> np.ndarray:
        """Ends moved right over equal words up to the text's end."""
        ends = ends.copy()
        for step in range(min(level, len(self._hashes) - 1), -1, -1) if len(ends) else ():
            width, hashes = 1 << step, self._hashes[step]
            while True:
                fits = ends + width <= self.size
                at = np.where(fits, ends, 0)
                more = fits & (hashes[at] == hashes[np.where(fits, at - periods, 0)])
                if not more.any():
                    break
                ends += width * more
        return ends


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words as equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def find_runs(numbers: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows ``(start, end, period)`` of a whole text's runs, by start, then period."""
    catchers = SquareCatchers()
    for begin in range(0, len(numbers), APPEND):
        catchers.append(numbers[begin : begin + APPEND])
    return catchers.runs(least_words, least_periods)


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    stay = np.cumsum(change[:-1]) == 0
    return [w for w, s in zip(words, stay.tolist(), strict=True) if s]


def folded(words: list[bytes], key: str) -> list[bytes]:
    """The contract's edit: of a tenth of the documents, by a checksum of the id, the words from a place on repeat."""
    h = zlib.crc32(key.encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * -(-(n - a) // p))[: n - a]


_RUNS = "array<struct<start: long, length: long, period: long>>"


def periodic_runs(
    docs: DataFrame,
    least_words: int = LEAST_WORDS,
    least_periods: int = LEAST_PERIODS,
    fold: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, runs, collapsed``, one row per row: all runs of whole texts, and the text without their repetitions.

    A run is a maximal stretch of words with smallest period q, at least ``least_words`` words
    and ``least_periods`` times q long; ``runs`` are ``(start, length, period)`` in words, by
    start, then period. ``collapsed`` has the kept words with one space between. Null, empty
    and blank texts have no words and no runs. Repeated rows give equal rows; ties can't
    occur, since ends and period name a run. With ``fold`` the contract's edit comes first (no doc_id: key ""). Other
    columns are not looked at. Words of one text are held as a list, with some 200 bytes a word beside it.
    """
    source = shipped(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.slice(begin, 256)
                found, kept = [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    words = (text.as_py() or b"").split()
                    if fold:
                        words = folded(words, "" if doc_id is None else str(doc_id))
                    runs = find_runs(numbered(words), least_words, least_periods)
                    found.append([{"start": s, "length": e - s, "period": p} for s, e, p in runs.tolist()])
                    kept.append(b" ".join(collapsed(words, runs) if len(runs) else words))
                columns = [part.column(0), pa.array(found, kind), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "collapsed"])

    return source.mapInArrow(run, f"doc_id long, runs {_RUNS}, collapsed string")


def digested(found: DataFrame) -> DataFrame:
    """The contract's columns: number of runs, the longest one (first by start, then period), checksums of runs and text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("by"), r["start"].alias("start"), r["period"].alias("period"))))
    top = found.withColumn("top", longest)
    length = -F.col("top.by")
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        length.alias("length"),
        F.col("top.period").alias("period"),
        F.floor(F.expr("(1000 * -top.by) div top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
