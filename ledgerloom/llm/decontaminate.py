"""Benchmark decontamination by the q-gram lemma.

Texts are compared as lower-cased runs of letters and digits joined by single spaces. A window
of ``window`` characters of a benchmark item leaks into a document if some part of the document
is within ``edits`` edits of it. Such a part shares at least ``window + 1 - q * (edits + 1)``
q-grams with the window, and their diagonals (document position minus item position) differ by
no more than ``edits``. So shared q-grams are counted per item in diagonal bands twice that
wide, each overlapping the next by half; a stretch of a band that reaches the bound is kept and
verified by a banded alignment. Nothing that meets the budget is missed.

Documents are only mapped: the benchmark goes to the tasks in blocks of bounded size and the
documents are read once per block, so nothing is shuffled and memory doesn't depend on either table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import shipped

WINDOW = 60
ERROR_RATE = 1 / 15
Q = 9
BLOCK_CHARS = 500_000
SEGMENT = 1 << 18

_TOKEN = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GAP = "\0"


def normal(text: str | None) -> str:
    return " ".join(_TOKEN.findall((text or "").lower()))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_codes(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code for each q-gram, doubling the span at each step. Equal grams have equal codes."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, span, grown = np.array([_BASE]), 1, chars.astype(np.uint64)
    done, out = 0, np.zeros(n, np.uint64)
    while True:
        if q & span:
            out = out * power + grown[done : done + n]
            done += span
        if done == q:
            return out
        grown = grown[:-span] * power + grown[span:]
        power, span = power * power, span * 2


@dataclass(frozen=True)
class Budget:
    """Window, edits and least shared q-grams for an item of a length; shorter items get all their length as window."""

    window: int
    edits: int
    least: int

    @classmethod
    def of(cls, length: int, window: int, rate: float, q: int) -> Budget | None:
        window = min(window, length)
        edits = min(int(window * rate), window // q - 1)
        return None if edits < 0 else cls(window, edits, window + 1 - q * (edits + 1))


class Index:
    """The q-grams of one block of benchmark items."""

    def __init__(self, items: Iterable[tuple[int, str]], window: int = WINDOW, rate: float = ERROR_RATE, q: int = Q):
        self.q = q
        self.ids, self.chars, self.budgets = [], [], []
        for item_id, text in items:
            text = normal(text)
            if budget := Budget.of(len(text), window, rate, q):
                self.ids.append(item_id)
                self.chars.append(points(text))
                self.budgets.append(budget)
        codes = [gram_codes(c, q) for c in self.chars]
        owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes] or [np.zeros(0, np.int64)])
        flat = np.concatenate(codes or [np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.codes, self.starts = np.unique(flat[order], return_index=True)
        self.starts = np.append(self.starts, len(flat))
        bits = max(16, (64 * len(self.codes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.marks = np.zeros(1 << bits, bool)
        self.marks[(self.codes * _BASE) >> self.shift] = True
        if self.ids:
            self.least = min(b.least for b in self.budgets)
            self.reach = max(b.window + b.edits for b in self.budgets)
            self.edits = np.array([b.edits for b in self.budgets])
            self.spans = np.array([b.window + b.edits - q for b in self.budgets])
            self.leasts = np.array([b.least for b in self.budgets])

    def shared(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``chars`` of q-grams of the block, and their rows in ``codes``, where enough lie close together."""
        codes = gram_codes(chars, self.q)
        at = np.flatnonzero(self.marks[(codes * _BASE) >> self.shift])
        rows = np.searchsorted(self.codes, codes[at])
        rows[rows == len(self.codes)] = 0
        exact = self.codes[rows] == codes[at] if len(self.codes) else np.zeros(len(at), bool)
        at, rows = at[exact], rows[exact]
        if len(at) < self.least:
            return at[:0], rows[:0]
        close = at[self.least - 1 :] - at[: len(at) - self.least + 1] <= self.reach - self.q
        cover = np.zeros(len(at) + 1, np.int64)
        cover[:-1][: len(close)] += close
        cover[self.least - 1 + np.flatnonzero(close) + 1] -= 1
        inside = np.cumsum(cover)[:-1] > 0
        return at[inside], rows[inside]

    def stretches(self, chars: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """``(item, lowest diagonal, highest, first position, last)`` of bands that reach the bound."""
        at, rows = self.shared(chars)
        if not len(at):
            return []
        counts = self.starts[rows + 1] - self.starts[rows]
        found: list[tuple[int, int, int, int, int]] = []
        # Common q-grams stand in many items: a bounded number of (position, item) pairs at a time,
        # the parts overlapping by what one window can reach.
        ends = np.cumsum(counts)
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + 4_000_000)))
            found += self._banded(at[begin:end], rows[begin:end], counts[begin:end])
            if end >= len(at):
                break
            begin = max(begin + 1, int(np.searchsorted(at, at[end - 1] - self.reach)))
        return list(dict.fromkeys(found))

    def _banded(self, at: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        again = np.repeat(np.arange(len(at)), counts)
        slot = self.starts[rows][again] + np.arange(len(again)) - np.repeat(np.cumsum(counts) - counts, counts)
        item, position = self.owner[slot], at[again]
        diagonal = position - self.place[slot]
        half = self.edits[item] + 1
        found: list[tuple[int, int, int, int, int]] = []
        band = np.floor_divide(diagonal, half)  # band b holds the diagonals of the halves b and b + 1
        i, b, p = np.tile(item, 2), np.concatenate([band, band - 1]), np.tile(position, 2)
        order = np.lexsort((p, b, i))
        i, b, p = i[order], b[order], p[order]
        other = np.ones(len(i), bool)  # a position counts once in a band
        other[1:] = (i[1:] != i[:-1]) | (b[1:] != b[:-1]) | (p[1:] != p[:-1])
        i, b, p = i[other], b[other], p[other]
        first = np.arange(len(i))
        last = first + self.leasts[i] - 1
        ok = last < len(i)
        last = np.minimum(last, len(i) - 1)
        ok &= (i[last] == i) & (b[last] == b) & (p[last] - p <= self.spans[i])
        run_end = -1
        for f in np.flatnonzero(ok):
            width = int(self.edits[i[f]]) + 1
            low = int(b[f]) * width
            if found and f <= run_end and found[-1][:2] == (int(i[f]), low):
                found[-1] = (*found[-1][:4], int(p[last[f]]))
            else:
                found.append((int(i[f]), low, low + 2 * width - 1, int(p[f]), int(p[last[f]])))
            run_end = int(last[f])
        return found

    def leaks(self, text: str) -> dict[int, list[tuple[int, int, int, int]]]:
        """Item row to ``(item window start, edits, part's start, part's end)`` in the normal text."""
        chars, out = points(text), {}
        if not self.ids or len(chars) < self.q:
            return out
        step = max(SEGMENT, 4 * self.reach)
        for begin in range(0, max(1, len(chars) - 2 * self.reach), step):
            part = chars[begin : begin + step + 2 * self.reach]
            for item, low, high, first, last in self.stretches(part):
                for start, edits, here, there in self.verified(item, part, low, high, first, last):
                    out.setdefault(item, {}).setdefault(start, (edits, here + begin, there + begin))
                    if edits < out[item][start][0]:
                        out[item][start] = (edits, here + begin, there + begin)
        return {item: [(start, *rest) for start, rest in sorted(found.items())] for item, found in out.items()}

    def verified(self, item: int, chars: np.ndarray, low: int, high: int, first: int, last: int) -> list[tuple[int, int, int, int]]:
        """The windows of the item that a stretch can hold: those without edits first, the rest by banded alignment."""
        budget, target = self.budgets[item], self.chars[item]
        window, edits = budget.window, budget.edits
        begin = max(0, first - high - window - edits + self.q)
        end = min(len(target) - window, last - low + edits)
        if end < begin:
            return []
        rest = np.ones(end + 1 - begin, bool)
        out = []
        for diagonal in range(low, high + 1):
            a, b = max(begin, -diagonal), min(end + window, len(chars) - diagonal)
            if b - a < window:
                continue
            same = np.concatenate([[0], np.cumsum(target[a:b] == chars[a + diagonal : b + diagonal])])
            for start in a + np.flatnonzero(same[window:] - same[:-window] == window):
                if rest[start - begin]:
                    rest[start - begin] = False
                    out.append((int(start), 0, int(start + diagonal), int(start + diagonal + window)))
        left_over = begin + np.flatnonzero(rest)
        left, width = low - edits, high - low + 2 * edits + 1
        for a in range(0, len(left_over), 512):
            starts = self._within(target, chars, left_over[a : a + 512], left, width, window, edits)
            if len(starts):
                out += self._aligned(target, chars, starts, left, width, window, edits)
        return out

    @staticmethod
    def _rows(target: np.ndarray, chars: np.ndarray, starts: np.ndarray, left: int, width: int, window: int):
        """Bands of the alignment: the first row of costs, and for row i what a match or a mismatch adds.

        Cell (i, j) stands before document position ``starts + i + left + j``; what is outside
        matches nothing. Both ends are free in the document.
        """
        columns = np.arange(width)
        corner = starts[:, None] + left + columns
        padded = np.concatenate([np.zeros(1, chars.dtype), chars, np.zeros(1, chars.dtype)])
        big = window + 1

        def added(i: int) -> np.ndarray:
            here = corner + i
            same = padded[np.clip(here + 1, 0, len(chars) + 1)] == target[starts + i][:, None]
            return np.where((here >= 0) & (here < len(chars)), np.where(same, 0, 1), big)

        return corner, np.where((corner < 0) | (corner > len(chars)), big, 0), added, columns

    @classmethod
    def _within(
        cls, target: np.ndarray, chars: np.ndarray, starts: np.ndarray, left: int, width: int, window: int, edits: int
    ) -> np.ndarray:
        """The windows within the edit budget, side by side; one that is beyond it goes early."""
        _, cost, added, columns = cls._rows(target, chars, starts, left, width, window)
        side = np.full((len(starts), 1), window + 1)
        for i in range(window):
            skip = np.concatenate([cost[:, 1:] + 1, side[: len(cost)]], axis=1)
            cost = np.minimum.accumulate(np.minimum(skip, cost + added(i)) - columns, axis=1) + columns
            if i % 4 == 3 and not (alive := cost.min(axis=1) <= edits).all():
                starts, cost = starts[alive], cost[alive]
                if not len(starts):
                    return starts
                _, _, added, _ = cls._rows(target, chars, starts, left, width, window)
        return starts[cost.min(axis=1) <= edits]

    @classmethod
    def _aligned(
        cls, target: np.ndarray, chars: np.ndarray, starts: np.ndarray, left: int, width: int, window: int, edits: int
    ) -> list[tuple[int, int, int, int]]:
        """Least edits of windows and the part of the document that they match."""
        origin, cost, added, columns = cls._rows(target, chars, starts, left, width, window)
        for i in range(window):
            step = cost + added(i)
            skip = np.concatenate([cost[:, 1:] + 1, np.full((len(starts), 1), window + 1)], axis=1)
            origin = np.where(skip < step, np.concatenate([origin[:, 1:], origin[:, -1:]], axis=1), origin)
            level = np.minimum(skip, step) - columns
            best = np.minimum.accumulate(level, axis=1)
            source = np.maximum.accumulate(np.where(level == best, columns, 0), axis=1)
            cost = best + columns
            origin = np.take_along_axis(origin, source, axis=1)
        finish = cost.argmin(axis=1)
        least = cost[np.arange(len(starts)), finish]
        return [
            (int(starts[r]), int(least[r]), int(origin[r, finish[r]]), int(starts[r] + window + left + finish[r]))
            for r in np.flatnonzero(least <= edits)
        ]


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple]]:
    """The benchmark in blocks of about ``block_chars`` characters, one at a time; only one is held."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = -(-total // block_chars)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for number in range(count):
        yield [(r[0], r[1]) for r in items.filter(block == number).orderBy("item_id", "text").collect()]


def _original(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places in the normal text as places in the lower-cased text."""
    found = [m.span() for m in _TOKEN.finditer(text.lower())]
    lengths = np.array([b - a for a, b in found])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    out = []
    for a, b in spans:
        i, j = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, max(a, b - 1), "right") - 1
        out.append((found[i][0] + min(a - int(starts[i]), int(lengths[i])), found[j][0] + min(b - int(starts[j]), int(lengths[j]))))
    return out


LEAK_SCHEMA = "doc_id long, item_id long, windows int, edits int, item_start int, item_end int, doc_start int, doc_end int"


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    rate: float = ERROR_RATE,
    q: int = Q,
    block_chars: int = BLOCK_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each document row and benchmark item of which a window leaks into it.

    ``windows`` counts the item's leaking windows, ``edits`` is their least number of edits,
    ``item_start, item_end`` span the leaking windows in the item's normal text, ``doc_start,
    doc_end`` what they match in the lower-cased document. An item shorter than the window is
    one window with an edit budget in proportion; one of fewer than ``q`` normal characters
    never leaks. Null and empty texts, and an empty benchmark, give no rows. Repeated rows
    give repeated rows; equal items are reported under each item_id.
    """
    source = shipped(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], LEAK_SCHEMA)
    for items in blocks(benchmark, block_chars):

        def run(frames: Iterator[pd.DataFrame], items=items) -> Iterator[pd.DataFrame]:
            index = Index(items, window, rate, q)
            names = [x.split()[0] for x in LEAK_SCHEMA.split(", ")]
            for frame in frames:
                rows = []
                for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                    for item, found in index.leaks(normal(text)).items():
                        size = index.budgets[item].window
                        (a, b), = _original(text, [(min(f[2] for f in found), max(f[3] for f in found))])
                        rows.append((doc_id, index.ids[item], len(found), min(f[1] for f in found), found[0][0], found[-1][0] + size, a, b))
                made = pd.DataFrame(rows, columns=names)
                yield made.astype({"doc_id": "Int64", "item_id": "Int64"})

        out = out.unionAll(source.mapInPandas(run, LEAK_SCHEMA))
    return out


def leaking(text: Column, items: list[tuple], window: int = WINDOW, rate: float = ERROR_RATE, q: int = Q) -> Column:
    """Whether a window of any item of one block leaks into the text."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(items, window, rate, q)
        for batch in batches:
            yield pd.Series([bool(index.leaks(normal(t))) for t in batch], dtype=bool)

    return run(text.cast("string"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs``, all columns, into which no benchmark item leaks. A filter: nothing is shuffled."""
    shipped(docs)
    for items in blocks(benchmark, settings.pop("block_chars", BLOCK_CHARS)):
        docs = docs.filter(~leaking(F.col(text_col), items, **settings))
    return docs
