"""Statement CSV files as all-STRING DataFrames, and header roles."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import carried, stored
from ledgerloom.sources import firsts
from ledgerloom.sources.records import joined_records, opens_quotes

carried(firsts)

# Cell texts read as missing.
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Where a row came from: file, start of its split and order inside the split.
LINEAGE = ["source_file", "source_block", "source_row"]

# The text of a row that has more or fewer cells than the header, NULL for all others.
BAD = "bad_record"

# Without column pruning every row's cells are counted, whatever columns are asked for.
CSV_OPTIONS = {
    "header": True, "encoding": "UTF-8", "quote": '"', "escape": '"', "enforceSchema": True, "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": BAD, "columnPruning": False,
}


def clean_header(name: str) -> str:
    return name.replace("﻿", "").strip()


def with_missing_as_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(MISSING_WORDS), F.col(f"`{c}`")) for c in columns})


def with_lineage(df: DataFrame) -> DataFrame:
    """Adds LINEAGE right after a file scan; their order is the row order inside a file."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("source_block"),
        F.monotonically_increasing_id().alias("source_row"),
    )


def header_names(line: str) -> list[str]:
    """Cleaned column names of a header line; a repeated name gets .1, .2 and so on, the first one keeps it."""
    names: list[str] = []
    for name in map(clean_header, next(csv.reader([line]), [])):
        again = sum(n == name or n.startswith(f"{name}.") and n[len(name) + 1 :].isdigit() for n in names)
        names.append(f"{name}.{again}" if again and name in names else name)
    return names


def statement_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (*LINEAGE, BAD)]


def statement_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def scan_statement(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """All rows of statement files of one layout, with LINEAGE and BAD. Malformed UTF-8 bytes become U+FFFD.

    Cells stay STRING (no inference pass), the usual words for a missing cell become
    NULL. Large files are split across tasks. Files in which a quoted cell goes over the end of a line are found by one scan;
    their records are joined (``joined_records``), all others are parsed straight away. A record that
    lacks cells or has too many is BAD. Without ``columns`` one header line is read.
    Files whose columns differ in order go through ``read_statements``.
    """
    paths = list(paths) if not isinstance(paths, str) else paths
    if columns is None:
        first = statement_headers(spark, paths).agg(F.min_by("header", "source_file")).first()
        columns = header_names((first and first[0]) or "")
    raw = spark.read.options(**CSV_OPTIONS).schema(statement_schema([*columns, BAD])).csv(paths)
    rows = with_lineage(with_bad(raw, columns))
    lines = with_lineage(spark.read.text(paths))
    open_files = stored(lines.filter(opens_quotes(F.col("value"))).select(F.col("source_file").alias("open_file")).distinct(), "open-files")
    if not open_files.isEmpty():
        same = F.col("source_file") == F.col("open_file")
        records = joined_records(lines.join(open_files, same, "left_semi").select(lines.columns))
        rows = rows.join(open_files, same, "left_anti").unionAll(_parsed(records, columns).select(rows.columns))
    return with_missing_as_null(rows, columns)


def _parsed(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of whole records, without the first record of each file, which is the header, and without blank ones."""
    place = F.struct("source_block", "source_row")
    text = records.filter(F.trim("record") != "")
    header = text.groupBy(F.col("source_file").alias("header_file")).agg(F.min(place).alias("header_place"))
    body = text.join(header, F.col("source_file") == F.col("header_file")).filter(place != F.col("header_place"))
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    names = ", ".join("`" + c.replace("`", "``") + "` STRING" for c in [*columns, BAD])
    cells = F.from_csv("record", names, options)
    return body.select(*LINEAGE, cells.alias("cells")).select(*LINEAGE, "cells.*")


def with_bad(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """BAD with nothing of the first cell appended: Spark refuses plans that read no column beside it."""
    nothing = F.substring(F.coalesce(F.col(f"`{columns[0]}`"), F.lit("")), 1, 0) if columns else F.lit("")
    return raw.withColumn(BAD, F.concat(BAD, nothing))


def read_statement(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``scan_statement`` that have a cell for each column."""
    return scan_statement(spark, paths, columns).filter(F.col(BAD).isNull()).drop(BAD)


def bad_rows(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """LINEAGE and text of the rows that ``read_statement`` leaves out."""
    return scan_statement(spark, paths, columns).filter(F.col(BAD).isNotNull()).select(*LINEAGE, BAD)


def statement_headers(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(source_file, header record), one row per file that isn't empty.

    A job over the file list: its tasks open their files and read from the start until the first record is whole, so
    the bytes read don't grow with the files. Only paths and sizes are listed, no content. Files in a store that pyarrow doesn't
    reach are read by Spark's text scan instead, of which first splits alone can hold a header.
    """
    listed = spark.read.format("binaryFile").load(list(paths) if not isinstance(paths, str) else paths).select(F.col("_metadata.file_path").alias("path"))
    files = listed.repartition(F.xxhash64("path"))

    first_record, size = firsts.first_record, firsts.HEADER_BYTES

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            found = []
            for path in frame["path"]:
                try:
                    store, place = fs.FileSystem.from_uri(path)
                    with store.open_input_stream(place) as stream:
                        found.append((path, first_record(iter(lambda s=stream: s.read(size), b""))))
                except (OSError, ValueError):
                    found.append((path, None))
            yield pd.DataFrame(found, columns=["source_file", "header"])

    read_here = stored(files.mapInPandas(read, "source_file string, header string"), "headers")
    if read_here.filter("header IS NULL").isEmpty():
        return read_here
    lines = with_lineage(spark.read.text(list(paths) if not isinstance(paths, str) else paths)).filter(F.col("source_block") == 0)
    return lines.filter(F.trim("value") != "").groupBy("source_file").agg(F.min_by("value", "source_row").alias("header"))


def layout_key(names: Sequence[str], spec: Mapping[str, Named | Holding] | None) -> tuple:
    """What files that can be read alike share: the names, or with ``spec`` the places of its roles and of account columns."""
    if spec is None:
        return tuple(names)
    places = {c: i for i, c in enumerate(names)}
    roles = tuple((role, places.get(found)) for role, found in find_roles(names, spec).items())
    accounts = tuple((i, re.sub("[ _]", "", c.lower())) for i, c in enumerate(names) if "acc" in c.lower() or "card" in c.lower())
    return len(names), roles, accounts


def read_statements(
    spark: SparkSession, paths: str | Sequence[str], spec: Mapping[str, Named | Holding] | None = None
) -> dict[str, DataFrame]:
    """Files of mixed layouts: all their rows, one DataFrame per layout, by a header of it.

    Spark maps CSV columns by position, so files are grouped by what stands where: without ``spec`` by their cleaned column names,
    with it by the places of its roles. A byte-order mark, blanks, or the case and names of other columns make no
    group of their own then. The caller normalises each layout and unions the results by name.
    """
    groups: dict[tuple, tuple[str, list[str]]] = {}
    for row in statement_headers(spark, paths).orderBy("source_file").toLocalIterator():
        header = row["header"] or ""
        groups.setdefault(layout_key(header_names(header), spec), (header, []))[1].append(unquote(row["source_file"]))
    return {header: scan_statement(spark, files, header_names(header)) for header, files in groups.values()}


@dataclass(frozen=True)
class Named:
    """The first of these exact column names that is present."""

    names: tuple[str, ...]

    def find(self, columns: Sequence[str]) -> str | None:
        return next((n for n in self.names if n in columns), None)


@dataclass(frozen=True)
class Holding:
    """The first column whose lower-case name contains one of ``parts`` or equals ``equal``."""

    parts: tuple[str, ...]
    equal: str | None = None

    def find(self, columns: Sequence[str]) -> str | None:
        for c in columns:
            name = c.lower()
            if name == self.equal or any(p in name for p in self.parts):
                return c
        return None


def find_roles(columns: Sequence[str], spec: Mapping[str, Named | Holding]) -> dict[str, str | None]:
    return {role: rule.find(columns) for role, rule in spec.items()}


def resolve_columns(
    df: DataFrame, spec: Mapping[str, Named | Holding], keep: Mapping[str, Column] | None = None
) -> tuple[DataFrame, dict[str, str | None]]:
    """One projection from file columns to roles, and the columns ``keep``; absent roles are NULL. Reads no data."""
    roles = find_roles(statement_columns(df), spec)
    lineage = [F.col(c) for c in LINEAGE if c in df.columns]
    picked = [
        (F.col(f"`{name}`") if name else F.lit(None).cast("string")).alias(role) for role, name in roles.items()
    ]
    return df.select(*lineage, *[c.alias(name) for name, c in (keep or {}).items()], *picked), roles


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))
