"""Toxic passages: maximum-scoring segments over token log-odds, with extreme-value calibration.

Training compares in how many toxic and clean documents a unit stands, a unit being a word or one of
its prefixes. Log-odds have an informative Dirichlet prior, each unit's share of all counts, so
rare units are drawn to no difference. A word scores what the longest of its units with enough
support scores, and every word costs a small drift, so that a run of ordinary words ends a passage. A linear scan finds all
maximal segments of positive score. By Karlin and Altschul's statistics the number of
segments of score S in n clean tokens is about ``K n exp(-lambda S)``; a segment is significant if
that is small, and ``lambda S - ln(K n)`` is its evidence whatever the document's length. A
document's segments are judged together by the Poisson count of those as good as the r-th best, for
every r, and a logistic curve fitted on the training rows turns that evidence into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, sampled_ids, shipped, stringed, texts_of

SAMPLE_ROWS = 20_000
SHORTEST, LONGEST = 3, 8
SUPPORT = 10
CERTAIN = 4.0
DRIFT = 0.2
EXPECTED = 0.01
CUTOFF = 0.7

_WORD = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 200_000


def units(word: str) -> list[str]:
    """The word, marked at its end, and its proper prefixes from LONGEST down to SHORTEST characters."""
    return [word + "$", *(word[:n] for n in range(min(LONGEST, len(word) - 1), SHORTEST - 1, -1))]


@dataclass
class Model:
    """``scores``: log-odds by unit, 0 for those with support but no certain difference below a certain one."""

    scores: dict[str, float]
    scale: float = 1.0
    rate: float = 1.0
    slope: float = 1.0
    offset: float = -3.0

    def word(self, word: str) -> float:
        """Log-odds of the word's longest known unit, less the drift."""
        return next((self.scores[u] for u in units(word) if u in self.scores), 0.0) - DRIFT

    def evidence(self, score: float, tokens: int) -> float:
        return self.scale * score - math.log(self.rate * max(tokens, 1))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * math.log1p(evidence) + self.offset))))

    def together(self, scores: list[float], tokens: int) -> tuple[float, int]:
        """-ln of the chance of the best r segments for the r that has the least, and that r.

        Segments of evidence x or more are a Poisson count of mean ``exp(-x)`` by chance, so r of them
        have a chance of ``exp(-r x) / r!`` at most, for every r and also where x is negative; trying
        each r halves the chance that is left. 0 where no segments say more than chance.
        """
        best, count = 0.0, 0
        for r, one in enumerate(sorted((self.evidence(s, tokens) for s in scores), reverse=True), 1):
            found = r * one + math.lgamma(r + 1) - r * math.log(2)
            if found > best:
                best, count = found, r
        return (best, count) if best >= -math.log(EXPECTED) else (0.0, 0)


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` in one scan; each list entry links to its last smaller start."""
    found: list[tuple[float, float, int, int, int]] = []
    total = 0.0
    for i, score in enumerate(scores):
        below, total = total, total + score
        if score <= 0:
            continue
        left, start = below, i
        k = len(found) - 1
        while True:
            while k >= 0 and found[k][0] >= left:
                k = found[k][4]
            if k < 0 or found[k][1] >= total:
                break
            left, _, start, _, link = found[k]
            del found[k:]
            k = link
        found.append((left, total, start, i + 1, k))
    return [(start, end, high - low) for low, high, start, end, _ in found]


class Scorer:
    """Scores texts in a task; word scores are remembered up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def _score(self, word: str) -> float:
        score = self.known.get(word)
        if score is None:
            if len(self.known) >= _CACHE_WORDS:
                self.known.clear()
            score = self.known[word] = self.model.word(word)
        return score

    def raw(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """Segments in tokens, and the number of tokens."""
        score = self._score
        scores = [score(w) for w in _WORD.findall((text or "").lower())]
        return (segments(scores) if scores and max(scores) > 0 else []), len(scores)

    def passages(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """A document's evidence and ``(start, end, evidence)`` of its passages, in characters of the lower-cased text.

        Passages are all segments whose own evidence is significant, and those that are so together.
        """
        found, tokens = self.raw(text)
        total, count = self.model.together([s for _, _, s in found], tokens)
        own = [self.model.evidence(s, tokens) for _, _, s in found]
        count = max(count, sum(e >= -math.log(EXPECTED) for e in own))
        if not count:
            return total, []
        best = sorted(sorted(zip(found, own, strict=True), key=lambda f: -f[1])[:count])
        places = [m.span() for m in _WORD.finditer((text or "").lower())]
        return total, [(places[a][0], places[b - 1][1], e) for (a, b, _), e in best]


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, label: str = "toxic") -> DataFrame:
    """``(text, label)`` of at most ``rows`` labelled documents, the smallest by a seeded hash; ``learn`` is a condition on the doc_id."""
    known = labels.filter(learn).select("doc_id", F.col(label).cast("int").alias("label")).filter("label IS NOT NULL")
    return texts_of(docs, sampled_ids(known, rows, label, "label"), stringed(F.col("text")), "label").select("text", "label")


def train(chosen: DataFrame) -> Model:
    """Fits the model on ``(text, label)``, a bounded sample, which is written once and read twice.

    The driver gets the significant units, and for each row of the sample the scores of its segments, some
    hundreds for a long text; the sample's bound (``training_rows``) bounds both. Null texts don't occur, as the sample has
    them empty; an empty sample, or one without rows of both labels, gives a model without units, whose every score
    is the share of toxic rows. Texts of any length are read whole.
    """
    scratch = Scratch(chosen.sparkSession, "toxicity")
    samples = scratch.keep(shipped(chosen).repartition(chosen.sparkSession.sparkContext.defaultParallelism))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen = [Counter(), Counter()]
            for text, label in zip(frame["text"], frame["label"], strict=True):
                seen[int(label > 0)].update({u for w in set(_WORD.findall(text.lower())) for u in units(w)})
            every = seen[0].keys() | seen[1].keys()
            yield pd.DataFrame([(u, seen[1][u], seen[0][u]) for u in every], columns=["unit", "toxic", "clean"])

    counts = samples.mapInPandas(count, "unit string, toxic long, clean long").groupBy("unit").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    sizes = samples.agg(F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    toxic_rows, clean_rows = int(sizes[0]), int(sizes[1] - sizes[0])
    if not toxic_rows or not clean_rows:
        share = min(max(toxic_rows / max(toxic_rows + clean_rows, 1), 0.01), 0.99)
        return Model({}, slope=0.0, offset=math.log(share / (1 - share)))
    # The prior weighs as much as the smaller class; a unit gets its share of all documents of it.
    weight = float(min(toxic_rows, clean_rows))
    prior = F.lit(weight) * (F.col("toxic") + F.col("clean")) / (toxic_rows + clean_rows)

    def odds(seen: str, rows: int) -> Column:
        return F.log((F.col(seen) + prior) / (rows + weight - F.col(seen) - prior + 1))

    spread = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    difference = odds("toxic", toxic_rows) - odds("clean", clean_rows)
    scored = scratch.keep(
        counts.filter(F.col("toxic") + F.col("clean") >= SUPPORT).select(
            "unit", difference.alias("odds"), (difference / spread >= CERTAIN).alias("certain")
        )
    )
    certain = scored.filter("certain").select(F.col("unit").alias("stem"))
    # Below a certain prefix a longer unit with support decides for itself.
    stems = F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda n: F.substr(F.col("unit"), F.lit(1), n))
    below = (
        scored.filter("NOT certain")
        .select("unit", F.explode(F.array_distinct(stems)).alias("prefix"))
        .join(certain, F.col("prefix") == F.col("stem"), "left_semi")
        .select("unit", F.lit(0.0).alias("odds"))
        .distinct()
    )
    known = scored.filter("certain").select("unit", "odds").unionAll(below)
    model = _calibrated(samples, Model({r["unit"]: r["odds"] for r in known.collect()}))
    scratch.drop(samples, scored)
    return model


def _calibrated(samples: DataFrame, model: Model) -> Model:
    def raw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for frame in frames:
            rows = []
            for text, label in zip(frame["text"], frame["label"], strict=True):
                found, tokens = scorer.raw(text)
                words = Counter(scorer._score(w) for w in _WORD.findall(text.lower())) if label <= 0 else {}
                up = [(s, n) for s, n in words.items() if s > 0]
                rows.append(
                    (int(label > 0), tokens, [s for _, _, s in found], sum(n for _, n in up), float(sum(s * n for s, n in up)))
                )
            yield pd.DataFrame(rows, columns=["label", "tokens", "found", "ups", "up_score"])

    rows = samples.mapInPandas(raw, "label int, tokens long, found array<double>, ups long, up_score double").collect()
    clean = [r for r in rows if not r["label"]]
    tokens = sum(r["tokens"] for r in clean)
    ups = sum(r["ups"] for r in clean) + 0.5
    usual = (sum(r["up_score"] for r in clean) + 0.5 * max(model.scores.values(), default=1.0)) / ups
    usual, share = max(usual, 0.1), min(ups / (tokens + 1), 0.5)
    # lambda: the positive root of E[exp(lambda s)] = 1 for a clean token's score s
    low, high = 1e-6, 50.0 / usual
    for _ in range(200):
        mid = (low + high) / 2
        if share * math.exp(min(mid * usual, 700)) + (1 - share) * math.exp(-mid * DRIFT) > 1:
            high = mid
        else:
            low = mid
    model.scale = max(low, 1e-3)
    # K: as many segments of the usual height as the clean rows show
    seen = sum(s >= usual for r in clean for s in r["found"]) + 0.5
    model.rate = seen / (max(tokens, 1) * math.exp(-model.scale * usual))
    x, y = [], []
    for r in rows:
        x.append(math.log1p(model.together(r["found"], r["tokens"])[0]))
        y.append(r["label"])
    model.slope, model.offset = _logistic(np.array(x), np.array(y, float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope, which is never negative, and offset, by Newton's method with a little ridge on the slope."""
    design, w = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + [ridge * w[0], 1e-4 * w[1]]
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag([ridge, 1e-4])
        step = np.linalg.solve(curve, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0), float(w[1])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, passages``, one row per row.

    ``passages`` are all segments that are significant alone or together, as ``(start, end, evidence)``;
    null and empty texts have none and the score of a text without evidence.
    """
    rows = shipped(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    @F.pandas_udf("score double, passages array<struct<start:int,end:int,evidence:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.passages(t) for t in batch]
            yield pd.DataFrame(
                {
                    "score": [model.probability(total) for total, _ in found],
                    "passages": [[{"start": a, "end": b, "evidence": e} for a, b, e in f] for _, f in found],
                }
            )

    return rows.select("doc_id", run("text").alias("found")).select("doc_id", "found.score", "found.passages")
