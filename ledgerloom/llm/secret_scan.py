"""Secrets in texts: fixed patterns, and character Markov models for what no pattern names.

Two first-order models over characters are trained from labelled samples, one of random strings
and one of ordinary identifiers. A candidate is a run of ``LEAST_PIECE`` or more letters, digits and plus signs:
token characters are cut at the separators ``/ = - _`` and at the patterns' spans, so that a random
part of a path, or one beside a span, is judged on its own. It is a secret if the log-likelihood
ratio of the two models passes a threshold, both in all, so that short pieces need clearer evidence, and per
transition. Everything is a column expression; the model is one array of
``CHARS ** 2`` ratios, whatever the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import match_spans, sampled_ids, stringed, texts_of

# Fixed patterns. Access and hex runs are greedy, so a run that is too short holds no other match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN_LEAST = 8

LEAST_PIECE = 16
# A word is tried at its start only.
PIECE = rf"(?<![A-Za-z0-9+])[A-Za-z0-9+]{{{LEAST_PIECE},}}+"
# In texts with pattern spans, pieces end where one begins, and begin where it ends, since it is consumed.
_BEGINS = r"""(?!AKIA[A-Z0-9]{12})(?![0-9a-f]{32})(?!(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=])"""
CUT = rf"{ASSIGN}|{ACCESS}|{HEX}|(?:(?<![A-Za-z0-9+])|\G)(?:{_BEGINS}[A-Za-z0-9+]){{{LEAST_PIECE},}}"
ORDINARY = r"[A-Za-z0-9_]{6,}"

# Printable ASCII; all else is one character more.
FIRST, CHARS = 32, 96
SAMPLE_ROWS = 20_000
PRIOR = 0.5
MARGIN, EVIDENCE = 0.25, 8.0


def char_codes(text: Column) -> Column:
    """Codes 0..CHARS-1 of the characters."""
    return F.transform(
        F.filter(F.split(text, ""), lambda c: c != ""),
        lambda c: F.when(F.ascii(c).between(FIRST, FIRST + CHARS - 2), F.ascii(c) - FIRST).otherwise(CHARS - 1),
    )


def transitions(text: Column) -> Column:
    """Numbers ``previous * CHARS + next`` of a text's transitions; none for fewer than two characters."""
    codes = char_codes(text)
    return F.when(F.length(text) < 2, F.array().cast("array<int>")).otherwise(
        F.zip_with(
            F.slice(codes, 1, F.size(codes) - 1),
            F.slice(codes, 2, F.size(codes) - 1),
            lambda a, b: (a * CHARS + b).cast("int"),
        )
    )


def train(samples: DataFrame, prior: float = PRIOR) -> list[float]:
    """Log-likelihood ratios of all transitions from ``(sample, is_random)``.

    Counts come from one aggregation to at most ``2 * CHARS ** 2`` rows. ``prior`` is added to
    each count, so unseen transitions, a missing label and an empty table give a model too.
    """
    seen = samples.filter("sample IS NOT NULL AND is_random IS NOT NULL").select(
        "is_random", F.explode(transitions(F.col("sample"))).alias("at")
    )
    counts = {(r[0], r[1]): r[2] for r in seen.groupBy("is_random", "at").count().collect()}
    ratios = []
    totals = {(k, a): sum(counts.get((k, a * CHARS + b), 0) for b in range(CHARS)) for k in (True, False) for a in range(CHARS)}
    for a in range(CHARS):
        for b in range(CHARS):
            log = [
                math.log((counts.get((k, a * CHARS + b), 0) + prior) / (totals[k, a] + prior * CHARS)) for k in (True, False)
            ]
            ratios.append(round(log[0] - log[1], 6))
    return ratios


def llr(text: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a text, the sum over its transitions; 0 where there are none."""
    ratios = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    return F.aggregate(transitions(text), F.lit(0.0), lambda s, t: s + F.element_at(ratios, t + 1))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the fixed patterns by kind. An assignment whose value is short is dropped after the search."""
    return {
        "assign": F.when(
            text.rlike(r"(?i:pass|secret|token|api)"),
            F.filter(
                match_spans(text, ASSIGN),
                lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 1)) >= ASSIGN_LEAST,
            ),
        ).otherwise(no_spans()),
        "access": F.when(F.contains(text, F.lit("AKIA")), match_spans(text, ACCESS)).otherwise(no_spans()),
        "hex": match_spans(text, HEX),
    }


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int,found:string>>")


def labelled_samples(docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(sample, is_random)`` from at most ``rows`` documents, the smallest by a seeded hash.

    The long values that the fixed patterns find are the random strings; runs of identifier
    characters in what is left of the text are the ordinary ones.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = texts_of(named, sampled_ids(named, rows, "secrets"), stringed(F.col("text")))
    value = F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1))
    random = F.concat(
        F.filter(value, lambda v: F.length(v) >= 16),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
    )
    rest = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    kinds = F.array(
        F.struct(F.lit(True).alias("is_random"), random.alias("found")),
        F.struct(F.lit(False).alias("is_random"), F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0)).alias("found")),
    )
    return chosen.select(F.explode(kinds).alias("kind")).select("kind.is_random", F.explode("kind.found").alias("sample"))


def find_secrets(
    docs: DataFrame, model: list[float], margin: float = MARGIN, evidence: float = EVIDENCE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, spans, n_assign, n_access, n_hex``, one row per row; null text is empty and has no spans.

    ``spans`` is an array of ``(start, kind, end, score)`` by start, then kind (its place in
    ``KINDS``). The patterns decide alone and have no score; a model span's is its log-likelihood ratio per
    transition, at least ``margin``, and ``evidence`` in all. Model spans never touch a span of the patterns.
    Repeated rows give equal rows, empty tables none. Texts of any length are searched whole.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), stringed(F.col(text_col)).alias("text"))
    base = F.concat("assign", "access", "hex")
    cut = F.when(~text.rlike(PIECE), no_spans()).when(F.size(base) > 0, match_spans(text, CUT)).otherwise(match_spans(text, PIECE))
    found = rows.withColumns(base_spans(text)).withColumn("cut", cut)
    pieces = F.filter("cut", lambda c: c["found"].rlike(f"^{PIECE}$"))
    judged = F.transform(pieces, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), llr(c["found"], model).alias("total")))
    random = F.filter("judged", lambda c: (c["total"] >= evidence) & (c["total"] >= margin * (c["end"] - c["start"] - 1)))
    # few pieces are random and few spans stand in a text, and only documents with both compare them
    free = F.filter("random", lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    found = found.withColumn("judged", judged).withColumn("random", random).withColumn("markov", free)

    def numbered(number: int, spans: str) -> Column:
        def one(s: Column) -> Column:
            score = s["total"] / (s["end"] - s["start"] - 1) if number == 3 else F.lit(None).cast("double")
            return F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), score.alias("score"))

        return F.transform(spans, one)

    spans = F.array_sort(F.concat(*(numbered(n, kind) for n, kind in enumerate(KINDS))))
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    return found.select("doc_id", spans.alias("spans"), *counts)


def joined(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end``, comma-joined in the array's order."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
