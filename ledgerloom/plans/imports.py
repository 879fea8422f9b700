"""Import of statement files: read, find accounts, normalise, categorise, check, append."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import MONEY
from ledgerloom.functions.text import account_label, fingerprint_bytes
from ledgerloom.operators.categorise import categorise_batch
from ledgerloom.operators.maintain import account_ids, add_accounts, check_constraints, first_of_each, months_of
from ledgerloom.operators.normalise import (
    CELLS, cells_of, file_accounts, institutions, layout_of, parsed_rows, split_rejects, with_fingerprint,
)
from ledgerloom.operators.numbering import assign_ids, row_index
from ledgerloom.operators.views import resolve_category
from ledgerloom.plans.reports import import_summary
from ledgerloom.session import stored
from ledgerloom.sources.statements import BAD, LINEAGE, read_statements, statement_columns

# Where a row stands among the written rows of an import: its frame, which of its file's accounts it is of, and its
# number in the frame. Unlike LINEAGE it is never NULL or repeated.
PLACE = ["frame", "account_nth", "row_number"]

# A row of marks is of 2**BLOCK_BITS row numbers. Row numbers are counted from 2**TASK_BITS times the number of the task that writes
# the row. New rows are found in passes, each with the marks of at most MOST_BLOCKS rows, 134 million places in some 20 MB.
BLOCK_BITS, TASK_BITS, MOST_BLOCKS = 12, 33, 1 << 15


@dataclass
class Imported:
    """Frames of one import.

    ``batch`` holds every row that fits, ``fresh`` where the new ones come from,
    ``added`` the new ones with their category.
    """

    batch: DataFrame
    fresh: DataFrame
    added: DataFrame
    rejected: DataFrame
    accounts: DataFrame

    def summary(self) -> DataFrame:
        return import_summary(self.batch, self.fresh, self.rejected)

    def numbered(self, ledger: DataFrame) -> DataFrame:
        """The new rows with transaction ids that follow the ledger's highest."""
        rows = assign_ids(self.added, ["hash"], ledger.agg(F.max("id")), digits=4)
        return rows.drop(*LINEAGE)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    result = frames[0]
    for other in frames[1:]:
        result = result.unionByName(other, allowMissingColumns=True)
    return result


def link_accounts(files: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(account table with new accounts, one row per file with account_id).

    Both are small next to the rows and are read by every later step, so they are
    written out instead of scanning the statements again.
    """
    wanted = institutions(files).select(
        "source_file", F.col("account_label").alias("name"), F.col("bank").alias("institution"),
        F.col("account_type").alias("type"), "account_number", F.col("institution").alias("statement_kind"),
    )
    table = stored(add_accounts(accounts, wanted), "accounts")
    ids = account_ids(table, wanted).select(
        "source_file", F.col("statement_kind").alias("institution"), F.col("name").alias("account_label"),
        "account_number", "account_id",
    )
    return table, stored(ids, "file-accounts")


def _file_accounts(held: DataFrame, columns: list[str], institution: str, given: DataFrame | None) -> DataFrame:
    """The files' accounts; what ``given`` says about a file goes before what is found in it."""
    found = file_accounts(cells_of(held, columns), institution)
    if given is None:
        return found
    told = given.select("source_file", F.col("account_name").alias("_name"), F.col("account_number").alias("_number"))
    joined = found.join(told, "source_file", "left").withColumn("account_number", F.coalesce("_number", "account_number"))
    label = F.coalesce("_name", account_label(F.lit(institution), "account_number"))
    return joined.withColumn("account_label", label).select(found.columns)


def _judged(
    every: DataFrame, ids: DataFrame, accounts: DataFrame, children: DataFrame, float_amounts: bool
) -> tuple[DataFrame, DataFrame]:
    """(rows that fit, with account, fingerprint, file_number and PLACE; rejects with ``reason`` and their cells). Rows without a date cell are in neither."""
    dated = every.filter(F.col(BAD).isNull() & F.col("date_raw").isNotNull())
    readable, unreadable = split_rejects(with_fingerprint(dated.join(ids, "source_file"), float_amounts))
    # of the account table only the files' accounts, so that rows, most of which may be of one account, meet a small table
    used = stored(ids.select(F.col("account_id").alias("id")).distinct().join(accounts.select("id"), "id", "left_semi"), "used-accounts")
    fits, broken = check_constraints(
        resolve_category(readable, children), ["account_id", "date", "description", "amount"],
        {"account_id": used, "child_category_id": children.select("id")},
    )
    bad = [
        unreadable.withColumn("reason", F.lit("unreadable date or amount")),
        broken,
        every.filter(F.col(BAD).isNotNull())
        .withColumn("reason", F.lit("more or fewer cells than the header")).withColumn(CELLS, F.array(BAD)),
    ]
    rejected = union_all([df.select(*LINEAGE, "reason", CELLS) for df in bad])
    return fits.withColumn("amount", F.col("amount").cast(MONEY)), rejected


def _with_numbers(ids: DataFrame) -> DataFrame:
    """Files with ``file_number``, their place in the order of names, so that rows are compared without their file's path.

    A file may be read for several accounts; ``account_nth`` tells them apart.
    """
    numbers = row_index(ids.select("source_file").distinct(), [F.col("source_file")], "file_number")
    nth = F.row_number().over(Window.partitionBy("source_file").orderBy("institution", "account_label", "account_number"))
    return stored(ids.withColumn("account_nth", nth).join(numbers, "source_file"), "file-numbers")


def first_places(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """PLACE of the batch rows whose fingerprint is neither in the ledger nor earlier in the batch.

    The rows that ``new_rows`` keeps, found from fingerprints and positions alone: nothing else of a row is sorted or shuffled.
    Fingerprints of the batch are MD5 texts; one of the ledger that isn't is none of them.
    """
    order = ["file_number", "source_block", "source_row"]
    known = months_of(batch, ledger).select(fingerprint_bytes("hash").alias("_print"))
    prints = batch.select(F.unhex("hash").alias("_print"), *order, *PLACE)
    return first_of_each(prints, "_print", order).join(known, "_print", "left_anti").select(PLACE)


def place_marks(places: DataFrame) -> DataFrame:
    """Some places as bits, written: a row of 64 words for each 4,096 numbers of which one is among them."""
    *where, number = PLACE
    words = places.selectExpr(*where, f"{number} >> 6 AS _at", f"1L << CAST({number} & 63 AS INT) AS _bit")
    words = words.groupBy(*where, "_at").agg(F.bit_or("_bit").alias("_word"))
    held = F.map_from_entries(F.collect_list(F.struct(F.expr("CAST(_at & 63 AS INT)"), F.col("_word"))))
    blocks = words.groupBy(*where, F.shiftright("_at", BLOCK_BITS - 6).alias("_block")).agg(held.alias("_held"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at("_held", i), F.lit(0).cast("bigint")))
    return stored(blocks.select(*where, "_block", dense.alias("_words")), "new-places", "zstd")


def mark_ranges(marks: DataFrame, most: int = MOST_BLOCKS) -> list[tuple[int, int]]:
    """Ranges of row numbers, first and end, that hold all marks, each ``most`` blocks at most where no task wrote more.

    A row number begins with the task that wrote the row, so one count per task comes here.
    """
    counts = marks.groupBy(F.shiftright("_block", TASK_BITS - BLOCK_BITS).alias("task")).agg(F.count(F.lit(1)).alias("n"))
    ends, held = [0], 0
    for task, n in sorted(map(tuple, counts.collect())):
        if held and held + n > most:
            ends.append(task << TASK_BITS)
            held = 0
        held += n
    return list(zip(ends, [*ends[1:], 2**63 - 1], strict=True))


def rows_at(rows: DataFrame, marks: DataFrame, first: int, end: int) -> DataFrame:
    """The rows at the marked places of a range of row numbers.

    The range bounds the marks, which are an eighth of a byte per row, so they are broadcast: left to its own, Spark sizes the
    table by its compressed files, and shuffles all rows to meet the marks of a large import.
    """
    *where, number = PLACE
    some = F.broadcast(marks.filter(f"_block BETWEEN {first >> BLOCK_BITS} AND {(end - 1) >> BLOCK_BITS}"))
    near = rows.filter(f"{number} BETWEEN {first} AND {end - 1}").withColumn("_block", F.shiftright(number, BLOCK_BITS))
    met = near.join(some, [*where, "_block"])
    return met.filter(f"getbit(get(_words, CAST({number} >> 6 & 63 AS INT)), CAST({number} & 63 AS INT)) = 1").select(rows.columns)


def _added(fresh: DataFrame, rules: DataFrame, children: DataFrame) -> DataFrame:
    """New rows with their category, written."""
    named = resolve_category(categorise_batch(fresh, rules, children), children)
    added = named.select(
        *LINEAGE, "account_id", "date", "description", "original_desc", "amount",
        F.col("child_category_id").cast("bigint").alias("child_category_id"), "memo", F.lit(0).alias("is_split"),
        F.lit(0).alias("is_transfer"), "currency", F.lit("[]").alias("tags"),
        F.col("ai_confidence").cast("decimal(5,2)").alias("ai_confidence"), "rule_id", "hash",
    )
    return stored(added, "added", "zstd")


def import_frames(
    frames: Sequence[tuple[DataFrame, str]], ledger: DataFrame, accounts: DataFrame, children: DataFrame, rules: DataFrame,
    given: DataFrame | None = None, float_amounts: bool = False,
) -> Imported:
    """(statement rows, institution) pairs to new ledger rows.

    Each file is parsed once: the normalised rows are written with all their cells, and
    accounts are taken from that table. Months, counts, duplicates and rejects are scans of it, in which rows meet small
    tables only. New rows are told by their fingerprints and positions, and read again from there, in passes of bounded marks. Duplicates are
    dropped before categories are looked for, so a file that comes again costs no
    matching. ``given`` has the account_name and account_number (or NULL) of files
    (source_file) for which they are not to be found out. Rejects hold all cells of
    their row, a malformed row's text in one cell. ``float_amounts`` is for ledgers whose fingerprints hold float texts.
    """
    frame, _, number = PLACE
    parsed = [
        (stored(parsed_rows(df, layout_of(name)).withColumn(number, F.monotonically_increasing_id()), "parsed", "zstd"), statement_columns(df), name)
        for df, name in frames
    ]
    files = stored(union_all([_file_accounts(held, columns, name, given) for held, columns, name in parsed]), "files")
    account_table, ids = link_accounts(files, accounts)
    every = union_all([held.withColumn(frame, F.lit(n)) for n, (held, _, _) in enumerate(parsed)])
    fits, rejected = _judged(every, _with_numbers(ids), account_table, children, float_amounts)
    batch = fits.select(
        *LINEAGE, "account_id", "date", "description", "original_desc", "amount", "category", "memo", "currency", "hash"
    )
    marks = place_marks(first_places(fits, ledger))
    # one pass after the other, so that no more marks than those of one are in memory
    passes = [_added(rows_at(fits, marks, *some).select(batch.columns), rules, children) for some in mark_ranges(marks)]
    added = union_all(passes)
    return Imported(batch, added.select(batch.columns[:3]), added, rejected, account_table)


def import_statements(
    spark: SparkSession, sources: Mapping[str, str | Sequence[str]],
    ledger: DataFrame, accounts: DataFrame, children: DataFrame, rules: DataFrame, given: DataFrame | None = None,
    float_amounts: bool = False,
) -> Imported:
    """Files by institution, whatever their column order; ``given`` and ``float_amounts`` as in ``import_frames``."""
    frames = [
        (df, institution)
        for institution, paths in sources.items()
        for df in read_statements(spark, paths, layout_of(institution).spec).values()
    ]
    return import_frames(frames, ledger, accounts, children, rules, given, float_amounts)
