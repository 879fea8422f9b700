"""Mixing sources to target weights: capped water-filling and seeded repetitions.

A source gets a share of the budget by its weight, but at most ``max_epochs`` times its size:
sources above that are clamped and the excess goes to the others by weight, round after round,
until none is above. A target is then met by whole repetitions of all documents of the source
and, for the fraction left over, by documents in a seeded order until the fraction is filled.

The order inside a source is that of a hash, whose first digits are a bucket, so only one sum per
bucket is added up, and rows are ranked in the one bucket of each source where the fraction ends.
No task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, word_count
from ledgerloom.operators.numbering import row_index

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MAX_EPOCHS = 2.0
SEED = 17
BUCKET_DIGITS = 3


def ranked_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight``: the list's values in turn over the sources by code point, null last."""
    ranked = row_index(sources, [F.col("source").asc_nulls_last()], "nth")
    listed = F.array(*map(F.lit, weights))
    return ranked.withColumn("weight", F.element_at(listed, (F.col("nth") % len(weights)).cast("int") + 1)).drop("nth")


def water_filled(sources: DataFrame, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to ``(source, source_size, weight)``.

    ``budget`` is a multiple of all sizes. Only sums come to the driver, once a round, and each
    round but the last clamps at least one source, in practice many. A budget above what all
    sources may give leaves every source at its cap; a source of size or weight 0 gets 0.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * float(budget)
    level, clamped = 0.0, -1
    while True:
        above = F.col("weight") * level > cap
        full, weight, count = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(above, 1)),
        ).first()
        if count == clamped or not weight:
            break
        level, clamped = max(0.0, total - full) / weight, count
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    max_epochs: float = MAX_EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, repeats, taken``, one row per row.

    ``size`` counts words (null text: 0), null is a source of its own, ``repeats`` says how
    often the mix takes the document and ``taken`` is that times its size. A source's taken
    words differ from its target by at most half its largest document. The order depends on
    the seed, the doc_id, the source and the size alone, so a rerun gives the same; rows that agree
    in all of these are alike, and it doesn't matter which of them is taken.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "source", "size")]
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    bucket = F.conv(F.substring("draw", 1, BUCKET_DIGITS), 16, 10).cast("int")
    rows = scratch.keep(sized.withColumn("draw", draw).withColumn("bucket", bucket))
    return _placed(rows, scratch, weights, budget, max_epochs)


def _placed(rows: DataFrame, scratch: Scratch, weights, budget: float, max_epochs: float) -> DataFrame:
    fills = scratch.keep(rows.groupBy("source", "bucket").agg(F.sum("size").alias("fill")))
    sizes = scratch.keep(fills.groupBy("source").agg(F.sum("fill").alias("source_size")))
    targets = scratch.keep(water_filled(scratch.keep(ranked_weights(sizes, weights)), budget, max_epochs).drop("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("left_over", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = plan.withColumnRenamed("source", "plan_source")
    before = F.coalesce(
        F.sum("fill").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    same = F.col("source").eqNullSafe(F.col("plan_source"))
    # The bucket where the fraction ends: what lies before it is taken whole, what lies behind it not at all.
    ends = scratch.keep(
        fills.withColumn("before", before)
        .join(plan, same)
        .filter((F.col("before") <= F.col("left_over")) & (F.col("left_over") < F.col("before") + F.col("fill")))
        .select("plan_source", F.col("bucket").alias("end_bucket"), F.col("before").alias("end_before"))
    )
    both = plan.join(ends.withColumnRenamed("plan_source", "end_source"), F.col("plan_source").eqNullSafe(F.col("end_source")), "left")
    plan = scratch.keep(both.drop("end_source"))
    joined = rows.join(plan, same)
    last = F.coalesce("end_bucket", F.lit(16**BUCKET_DIGITS))
    outside = joined.filter(F.col("bucket") != last).withColumn("extra", (F.col("bucket") < last) & (F.col("left_over") > 0))
    order = Window.partitionBy("source").orderBy("draw", "doc_id", "size")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("end_before")
    inside = (
        joined.filter(F.col("bucket") == last)
        .withColumn("upto", upto)
        # the document on the edge is taken if that comes nearer to the target than leaving it
        .withColumn("extra", (F.col("upto") - F.col("size") / 2 <= F.col("left_over")) & (F.col("left_over") > 0))
        .drop("upto")
    )
    repeats = (F.col("whole") + F.col("extra").cast("long")).alias("repeats")
    return (
        outside.unionAll(inside)
        .select("doc_id", "source", "size", "source_size", "target", repeats)
        .withColumn("taken", F.col("repeats") * F.col("size"))
    )


def mixed_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings
) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    A row is known by its doc_id, source and size, on which alone the draw depends, so rows without
    a doc_id or with a repeated one have counts of their own. Where the mix's edge falls among rows
    that agree in all three, the first by a hash of the text are taken once more than the others.
    """
    found = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **settings)
    scratch = Scratch(docs.sparkSession, "mixed")
    drawn = scratch.keep(
        found.groupBy(F.col("doc_id").alias("drawn_id"), F.col("source").alias("drawn_source"), F.col("size").alias("drawn_size"))
        .agg(F.min("repeats").alias("times"), (F.sum("repeats") - F.min("repeats") * F.count(F.lit(1))).alias("once_more"))
        .filter("times > 0 OR once_more > 0")
    )
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("row_id"),
        F.col(f"`{source_col}`").alias("row_source"),
        word_count(text).alias("row_size"),
        F.xxhash64(text).alias("row_hash"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )

    def met(some: DataFrame) -> DataFrame:
        # merged at any size, as the ids grow with the rows
        same = [F.col(f"row_{c}").eqNullSafe(F.col(f"drawn_{c}")) for c in ("id", "source", "size")]
        return rows.join(some.hint("merge"), same)

    out = met(drawn.filter("once_more = 0")).select("row", "times")
    edges = drawn.filter("once_more > 0")
    if not edges.isEmpty():
        alike = Window.partitionBy("drawn_id", "drawn_source", "drawn_size").orderBy("row_hash")
        ranked = met(edges).withColumn("nth", F.row_number().over(alike))
        times = F.col("times") + (F.col("nth") <= F.col("once_more")).cast("long")
        out = out.unionAll(ranked.select("row", times.alias("times")).filter("times > 0"))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth")).select("row.*")
