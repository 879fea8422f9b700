"""One registered query for each operator, over the whole tables, and the SQL that must give the same rows.

Where SQL can't express an operator, ``tests/llm`` holds it against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, digest, exactdedup, lexical, linededup, mixing, periodic, pii, quality, secret_scan, sharding, simhash, toxicity
from ledgerloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def fold(parts: int) -> Column:
    """The fold of a document: crc32 of its doc_id as text, by remainder."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


@query
def op1_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=3, max_bits=2)


@query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = secret_scan.train(secret_scan.labelled_samples(docs))
    found = secret_scan.find_secrets(docs, model)
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(secret_scan.joined(base, secret_scan.KINDS), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans"), secret_scan.KINDS).alias("spans"),
    )


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "repeats")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    model = toxicity.train(toxicity.training_rows(docs, labels, fold(3) != 1))
    found = toxicity.scored(docs, model)
    passages = F.transform("passages", lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string")))
    return found.select(
        "doc_id",
        (fold(3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.CUTOFF).cast("int").alias("predicted"),
        F.array_join(passages, ",").alias("passages"),
    )


@query
def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.with_next(documents(spark, sf_dir))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] < pii.BASE_KINDS)
    return found.select(
        "doc_id",
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        F.sha2(secret_scan.joined(base, pii.KINDS), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans"), pii.KINDS).alias("spans"),
        "n_spans",
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    model = quality.train(quality.sampled(docs, labels, fold(5) != 0))
    scored = docs.select("doc_id", quality.score(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id",
        (fold(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= quality.CUTOFF).cast("int").alias("predicted"),
    )


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digested(periodic.periodic_runs(documents(spark, sf_dir), fold=True))


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return lexical.MaxSketchIndex.build(docs).search(docs, table(spark, sf_dir, "benchmark"))


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.dedup_exact(documents(spark, sf_dir))


# Blanks are x20 and x09 to x0D; letters outside ASCII keep their case.
UPPER, LOWER = linededup.UPPER, linededup.LOWER
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Sources above the water level are those before the first, by cap and weight, that the rest of the budget doesn't fill.
ORACLE["op4_mixing"] = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM sources),
levelled AS (
    SELECT *, row_number() OVER o AS nth, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
water AS (
    SELECT arg_min(level, nth) AS level FROM levelled WHERE weight * level <= cap),
planned AS (
    SELECT source, source_size, least(cap, weight * (SELECT level FROM water)) AS target FROM weighed),
left_over AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM planned),
ordered AS (
    SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
           sum(s.size) OVER (PARTITION BY s.source
               ORDER BY md5(concat_ws('|', '17', coalesce(CAST(s.doc_id AS VARCHAR), ''), coalesce(s.source, ''), CAST(s.size AS VARCHAR))), s.doc_id, s.size
               ROWS UNBOUNDED PRECEDING) AS upto
    FROM sized s JOIN left_over p ON s.source IS NOT DISTINCT FROM p.source),
taken AS (
    SELECT *, whole + CASE WHEN rest > 0 AND upto - size / 2 <= rest THEN 1 ELSE 0 END AS repeats FROM ordered)
SELECT doc_id, size, source_size, target, repeats * size AS taken, CAST(repeats AS BIGINT) AS repeats FROM taken"""

ORACLE["op7_line_dedup"] = f"""
WITH rows AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
    SELECT r, doc_id, unnest(range(1, len(lines) + 1)) AS nth, unnest(lines) AS line FROM rows),
keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lines),
owned AS (
    SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (
    SELECT r, keyed.doc_id, nth, line, coalesce(owner <> keyed.doc_id, false) AS gone FROM keyed LEFT JOIN owned USING (k))
SELECT min(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r"""

ORACLE["op12_ranked_search"] = f"""
WITH words AS (
    SELECT r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms
    FROM (SELECT row_number() OVER () AS r, * FROM documents)),
postings AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM words) GROUP BY r, term),
stats AS (
    SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS total FROM words),
lengths AS (
    SELECT r, doc_id, 25 + (75 * len(terms) * docs) // total AS m FROM words, stats WHERE len(terms) > 0),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), stats),
asked AS (
    SELECT item_id, term, count(*) AS times
    FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark) GROUP BY item_id, term),
scored AS (
    SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (r) GROUP BY item_id, r, doc_id),
ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10"""

ORACLE["op13_exact_dedup"] = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY digest) AS keep_id, count(*) OVER (PARTITION BY digest) AS group_size,
       row_number() OVER (PARTITION BY digest ORDER BY doc_id NULLS LAST) = 1 AS kept, digest AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS digest FROM documents)"""
