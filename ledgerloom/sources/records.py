"""CSV records that go over several lines, found without giving up the split of large files.

A line either leaves open whether a quoted cell goes on (no quotes), or decides it, or turns it round. Such effects
are combined like the lines follow each other: inside chunks of some lines by a running window, then over the
chunks of a file, of which there is one short row each. So every line knows whether it begins a record, and
only the lines of records that have several are brought together. A task's windows hold a chunk at a time, however large
files and splits are: what a window holds can't be spilled for the sake of the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import stored

# At most 2**CHUNK_BITS lines of a split have their effects combined by one window.
CHUNK_BITS = 15

# States at a place in a line: in an unquoted cell, inside quotes, right after a closing quote, at the line's start.
_PLAIN, _INSIDE, _CLOSED, _START = 0, 1, 2, 3


def _ends_inside(line: Column, start: int) -> Column:
    """Whether a line that starts in a state ends inside quotes.

    A quote opens only where a cell begins, and inside quotes a doubled one is text; any other is a character.
    """
    pieces = F.split(line, '"')

    def quote(state: Column, piece: Column) -> Column:
        at, before = state["at"], state["before"]
        opens = before.endswith(",") | ((at == _START) & (before == ""))
        after = (
            F.when(at == _INSIDE, _CLOSED)
            .when((at == _CLOSED) & (before == ""), _INSIDE)
            .when(opens, _INSIDE)
            .otherwise(_PLAIN)
        )
        return F.struct(after.alias("at"), piece.alias("before"))

    first = F.struct(F.lit(start).alias("at"), F.get(pieces, F.lit(0)).alias("before"))
    return F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), first, quote, lambda s: s["at"] == _INSIDE)


def _quoted(line: Column) -> Column:
    return F.contains(line, F.lit('"'))


def opens_quotes(line: Column) -> Column:
    """Whether a record that starts with this line goes on in the next."""
    return F.when(_quoted(line), _ends_inside(line, _START)).otherwise(F.lit(False))


def stays_open(line: Column) -> Column:
    """Whether a cell that the line before left open is still open, or another one is, after this line."""
    return F.when(_quoted(line), _ends_inside(line, _INSIDE)).otherwise(F.lit(True))


def _running(constant: str, turns: str, window) -> tuple[Column, Column]:
    """Over a window: what the last deciding row says, with the turns since; and all turns, for where nothing has decided."""
    turned = F.sum(turns).over(window)
    decided = F.last(F.when(F.col(constant).isNotNull(), F.struct(F.col(constant).alias("value"), F.col("_turned").alias("at"))), True).over(window)
    return turned, decided


def _state(decided: Column, turned: Column, start: Column | None) -> Column:
    """0 or 1 after a row; without ``start`` NULL where nothing has decided."""
    known = F.pmod(decided["value"] + turned - decided["at"], F.lit(2))
    if start is None:
        return known
    return F.coalesce(known, F.pmod(start + turned, F.lit(2)))


def joined_records(lines: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """``source_file, source_block, source_row, record`` of whole files' ``(source_file, source_block, source_row, value)``, written.

    The position is that of the record's first line; its lines are joined by a line feed. A quote that the file never
    closes ends with its line, and the lines after it are records of their own, as otherwise the rest of a
    file would be one cell. ``lines`` is read once: lines are written with their effects, and what follows are scans of that.
    """
    opens, stays = opens_quotes(F.col("value")).cast("int"), stays_open(F.col("value")).cast("int")
    effects = lines.withColumns({"_opens": opens, "_stays": stays, "_chunk": F.shiftright("source_row", chunk_bits)})
    effects = effects.withColumns(
        {"_constant": F.when(F.col("_opens") == F.col("_stays"), F.col("_opens")), "_turns": F.when((F.col("_opens") == 1) & (F.col("_stays") == 0), 1).otherwise(0)}
    )
    chunk = ["source_file", "source_block", "_chunk"]
    by_line = Window.partitionBy(*chunk).orderBy("source_row")
    by_row = by_line.rowsBetween(Window.unboundedPreceding, 0)
    inside = effects.withColumn("_turned", F.sum("_turns").over(by_row))
    inside = inside.withColumn("_decided", _running("_constant", "_turns", by_row)[1])
    inside = inside.withColumn("_known", _state(F.col("_decided"), F.col("_turned"), None))
    # before the first line of a chunk nothing has decided and nothing turned
    inside = inside.withColumns({"_known_before": F.lag("_known").over(by_line), "_turned_before": F.coalesce(F.lag("_turned").over(by_line), F.lit(0))})
    inside = stored(inside.select(*chunk, "source_row", "value", "_known", "_turned", "_known_before", "_turned_before"), "line-effects")

    # one row a chunk: its effect, and over the chunks of a file the state in which each begins
    chunks = inside.groupBy(*chunk).agg(
        F.max_by(F.struct(F.col("_known").alias("constant"), F.pmod("_turned", F.lit(2)).alias("turns")), "source_row").alias("_last")
    )
    next_chunk = Window.partitionBy("source_file").orderBy("source_block", "_chunk")
    by_chunk = next_chunk.rowsBetween(Window.unboundedPreceding, 0)
    chunks = chunks.select(*chunk, F.col("_last.constant").alias("_constant"), F.when(F.col("_last.constant").isNull(), F.col("_last.turns")).otherwise(0).alias("_turns"))
    chunks = chunks.withColumn("_turned", F.sum("_turns").over(by_chunk))
    chunks = chunks.withColumn("_decided", _running("_constant", "_turns", by_chunk)[1])
    chunks = chunks.withColumn("_end", _state(F.col("_decided"), F.col("_turned"), F.lit(0)))
    starts = stored(chunks.select(*chunk, F.coalesce(F.lag("_end").over(next_chunk), F.lit(0)).alias("_start")), "chunk-starts")

    after = F.coalesce("_known", F.pmod(F.col("_start") + F.col("_turned"), F.lit(2)))
    before = F.coalesce("_known_before", F.pmod(F.col("_start") + F.col("_turned_before"), F.lit(2)))
    placed = inside.join(starts, chunk).withColumns({"_after": after, "_before": before})
    # after the last line of a file that leaves nothing open, a quote is never closed
    last = placed.filter("_after = 0").groupBy(*chunk).agg(F.max("source_row").alias("_row"))
    closed = last.groupBy("source_file").agg(F.max(F.struct("source_block", F.col("_row").alias("source_row"))).alias("_closed"))
    ends = stored(starts.join(closed, "source_file", "left"), "chunk-ends")
    placed = inside.join(ends, chunk).withColumns({"_after": after, "_before": before})
    place = F.struct("source_block", "source_row")
    placed = placed.withColumn("_alone", F.col("_closed").isNull() | (place > F.col("_closed")))
    placed = placed.withColumn("_head", F.col("_alone") | (F.col("_before") == 0))
    single = F.col("_head") & (F.col("_alone") | (F.col("_after") == 0))
    alone = placed.filter(single).select("source_file", "source_block", "source_row", F.col("value").alias("record"))

    # a line that goes on belongs to the last head before it, in its chunk or an earlier one; that head has several lines too
    several = placed.filter(~single)
    heads = several.groupBy(*chunk).agg(F.max(F.when(F.col("_head"), F.col("source_row"))).alias("_row"))
    earlier = next_chunk.rowsBetween(Window.unboundedPreceding, -1)
    last_head = F.last(F.when(F.col("_row").isNotNull(), F.struct(F.col("source_block").alias("block"), F.col("_row").alias("row"))), True).over(earlier)
    heads = heads.select(*chunk, last_head.alias("_earlier"))
    own = F.last(F.when(F.col("_head"), F.struct(F.col("source_block").alias("block"), F.col("source_row").alias("row"))), True).over(by_row)
    several = several.withColumn("_own", own).join(heads, chunk).withColumn("_record", F.coalesce("_own", "_earlier"))
    joined = several.groupBy("source_file", "_record").agg(F.array_sort(F.collect_list(F.struct("source_block", "source_row", "value"))).alias("_lines"))
    record = F.array_join(F.transform("_lines", lambda x: x["value"]), "\n").alias("record")
    whole = alone.unionAll(joined.select("source_file", F.col("_record.block").alias("source_block"), F.col("_record.row").alias("source_row"), record))
    return stored(whole, "records")
