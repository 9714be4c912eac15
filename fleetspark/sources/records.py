"""Lines made whole: cells that hold line breaks, and UTF-16, in files that many tasks read.

A file's physical lines lie in splits (``block``), in order of ``seq`` inside each. Whether a line begins a record depends on all
lines before it, so it is worked out in two levels: every split is summed up as a function of the state in which it begins, the
functions are composed in the order of the splits, and inside a split a window does the rest. A window holds one split, and the
walk over splits one row for each.

A state is whether a quoted cell is open. A line's effect on it is one of four functions: it leaves the state as it is, turns it
over, or ends open or closed whatever came before. Composed, it is the last line of the third kind that counts, and the
number of turns since.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.sources.lines import BYTES, byte_text, java_charsets

#: Characters that a record of several lines may have. A quoted cell that goes on for longer, or to the end of the file, is not
#: taken for one: its lines stay rows of their own.
MAX_RECORD = 1 << 20


def ends_open(raw: Column, delimiter: str, begins_open: bool = False) -> Column:
    """Whether a quoted cell is open at the end of a line. A quote opens a cell at its beginning only; inside, two are one."""
    d = re.escape(delimiter)
    line = F.concat(F.lit(delimiter + ('"' if begins_open else "")), raw)
    left = F.regexp_replace(line, f'{d}"(?:[^"]++|"")*+"[^{d}]*+', delimiter.replace("\\", "\\\\").replace("$", "\\$"))
    # without a quote at the beginning of a cell none opens
    some = raw.contains('"') if begins_open else line.contains(delimiter + '"')
    return F.when(some, left.contains(delimiter + '"')).otherwise(F.lit(begins_open))


def _carried(rows: DataFrame, over: Window, start: Column, name: str) -> DataFrame:
    """Adds ``name``, the state before each row, from ``fixed`` (the state a row ends in whatever came before, else null) and
    ``turns`` (whether it turns the state over)."""
    past = over.rowsBetween(Window.unboundedPreceding, -1)
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.coalesce(F.sum("turns").over(upto), F.lit(0)))
    since = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", F.col("_sum").alias("at"))), True).over(past)
    rows = rows.withColumn("_since", since).withColumn("_before", F.col("_sum") - F.col("turns"))
    begun = F.when(F.col("_since").isNull(), start + F.col("_before")).otherwise(F.col("_since.fixed") + F.col("_before") - F.col("_since.at"))
    return rows.withColumn(name, F.pmod(begun, F.lit(2))).drop("_sum", "_since", "_before")


def quote_states(lines: DataFrame, delimiters: list[str]) -> DataFrame:
    """``lines`` (with their file's delimiter) and open_before, open_after: 1 where a quoted cell is open."""
    closed, opened = F.lit(False), F.lit(True)
    for d in delimiters:
        closed = F.when(F.col("delimiter") == d, ends_open(F.col("raw"), d)).otherwise(closed)
        opened = F.when(F.col("delimiter") == d, ends_open(F.col("raw"), d, True)).otherwise(opened)
    told = lines.withColumn("_closed", closed.cast("int")).withColumn("_opened", opened.cast("int"))
    told = told.withColumn("fixed", F.when(F.col("_closed") == F.col("_opened"), F.col("_closed"))).withColumn(
        "turns", F.when(F.col("_closed") > F.col("_opened"), 1).otherwise(0))
    # a split as one function: what its last line of fixed end makes of the turns behind it
    inside = Window.partitionBy("file", "block").orderBy("seq")
    summed = told.withColumn("_sum", F.sum("turns").over(inside))
    blocks = summed.groupBy("file", "block").agg(
        F.max_by(F.struct("fixed", F.col("_sum").alias("at")), F.when(F.col("fixed").isNotNull(), F.col("seq"))).alias("_last"), F.sum("turns").alias("_turns"))
    blocks = blocks.select(
        "file", "block", F.pmod(F.col("_last.fixed") + F.col("_turns") - F.col("_last.at"), F.lit(2)).alias("fixed"),
        F.when(F.col("_last").isNull(), F.col("_turns") % 2).otherwise(0).alias("turns"))
    starts = _carried(blocks, Window.partitionBy("file").orderBy("block"), F.lit(0), "_start").select("file", "block", "_start")
    out = _carried(told.join(starts, ["file", "block"]), inside, F.col("_start"), "open_before")
    after = F.when(F.col("open_before") == 1, F.col("_opened")).otherwise(F.col("_closed"))
    return out.withColumn("open_after", after).drop("_closed", "_opened", "fixed", "turns", "_start")


def joined(lines: DataFrame, starts: Column, between: str = "\n", longest: int = MAX_RECORD) -> DataFrame:
    """Records: every line for which ``starts`` holds, with the lines up to the next such one behind it. Columns as in ``lines``;
    block and seq are those of the first line. A record longer than ``longest`` falls back into its lines."""
    inside = Window.partitionBy("file", "block").orderBy("seq")
    marked = lines.withColumn("_starts", starts)
    own = F.when(F.col("_starts"), F.struct("block", "seq"))
    over = Window.partitionBy("file").orderBy("block")
    # what a split owes to the one before, and what the one behind owes to it
    edges = (
        marked.groupBy("file", "block").agg(F.max_by(F.struct("block", "seq"), F.when(F.col("_starts"), F.col("seq"))).alias("_tail"), F.min_by("_starts", "seq").alias("_first"))
        .withColumn("_owner", F.last("_tail", True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_next_block", F.lead("_first").over(over)).select("file", "block", "_owner", "_next_block")
    )
    placed = (
        marked.withColumn("_mine", F.last(own, True).over(inside)).withColumn("_next", F.lead("_starts").over(inside))
        .join(edges, ["file", "block"])
        .withColumn("_begin", F.coalesce("_mine", "_owner", F.struct("block", "seq")))
        .withColumn("_alone", F.col("_starts") & F.coalesce("_next", "_next_block", F.lit(True)))
    )
    names = lines.columns
    several = placed.where(~F.col("_alone"))
    sizes = several.groupBy("file", "_begin").agg(F.sum(F.length("raw") + 1).alias("_size"))
    several = several.join(sizes, ["file", "_begin"])
    broken = several.where(F.col("_size") > longest).select(*names)
    texts = F.array_sort(F.collect_list(F.struct("block", "seq", "raw")))
    others = [c for c in names if c not in ("file", "block", "seq", "raw")]
    whole = several.where(F.col("_size") <= longest).groupBy("file", "_begin").agg(
        F.array_join(F.transform(texts, lambda t: t["raw"]), between).alias("raw"), *[F.first(c).alias(c) for c in others])
    whole = whole.select(*[F.col(f"_begin.{c}").alias(c) if c in ("block", "seq") else F.col(c) for c in names])
    return placed.where("_alone").select(*names).unionByName(whole).unionByName(broken)


def quoted_records(lines: DataFrame, delimiters: list[str], longest: int = MAX_RECORD) -> DataFrame:
    """Rows of files whose quoted cells hold line breaks. ``lines`` has the file's delimiter. A cell that does not end is none."""
    told = quote_states(lines, delimiters)
    # a file that ends inside a cell: the lines from where the cell opened are rows
    last = told.groupBy("file").agg(F.max_by("open_after", F.struct("block", "seq")).alias("_open_end"))
    opened = told.where((F.col("open_before") == 0) & (F.col("open_after") == 1)).groupBy("file").agg(F.max(F.struct("block", "seq")).alias("_from"))
    ends = last.where("_open_end = 1").join(opened, "file").select("file", "_from")
    told = told.join(ends, "file", "left")
    endless = F.coalesce(F.struct("block", "seq") >= F.col("_from"), F.lit(False))
    return joined(told.select(*lines.columns, ((F.col("open_before") == 0) | endless).alias("_begins")), F.col("_begins"), longest=longest).select(*lines.columns)


def utf16_lines(pieces: DataFrame) -> DataFrame:
    """Lines of UTF-16 files, each as the bytes of its UTF-8 form, from pieces between bytes 0x0A, blank ones among them.

    Such a byte ends a line only if it is one half of a line feed: it must lie at the place of that half, by the number of bytes
    before it, and the byte beside it must be zero.
    """
    inside = Window.partitionBy("file", "block").orderBy("seq")
    over = Window.partitionBy("file").orderBy("block")
    size = F.length("raw") + 1
    blocks = pieces.groupBy("file", "block").agg(F.sum(size).alias("_size"), F.min_by(F.substring("raw", 1, 2), "seq").alias("_mark"))
    blocks = blocks.select("file", "block", (F.sum("_size").over(over) - F.col("_size")).alias("_before"),
                           F.first("_mark").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_mark"))
    low_first = F.col("_mark") == "ÿþ"
    told = (
        pieces.join(blocks, ["file", "block"])
        .withColumn("_at", F.col("_before") + F.sum(size).over(inside) - size)
        .withColumn("_low_first", low_first).drop("_before", "_mark")
    )
    end = F.col("_at") + F.length("raw")
    told = told.withColumn("_breaks", ~F.col("_low_first") & (end % 2 == 1) & F.col("raw").endswith("\0"))
    edges = told.groupBy("file", "block").agg(F.max_by("_breaks", "seq").alias("_last"))
    edges = edges.select("file", "block", F.lag("_last").over(over).alias("_break_before"))
    told = told.join(edges, ["file", "block"])
    after_break = F.coalesce(F.lag("_breaks").over(inside), "_break_before", F.lit(True))
    starts = (F.col("_at") == 0) | F.when(F.col("_low_first"), (F.col("_at") % 2 == 1) & F.col("raw").startswith("\0")).otherwise(after_break)
    told = told.select("file", "block", "seq", "raw", "_low_first", "_at", starts.alias("_begins"))
    whole = joined(told, F.col("_begins"), longest=1 << 30)
    with java_charsets(pieces.sparkSession):
        # the half of the line feed before a line, or behind it, is not of the line
        ahead = F.when(F.col("_low_first") & (F.col("_at") > 0), F.substring("raw", 2, 1 << 30)).otherwise(F.col("raw"))
        body = F.when(~F.col("_low_first") & (F.length(ahead) % 2 == 1), F.substring(ahead, F.lit(1), F.length(ahead) - 1)).otherwise(ahead)
        data = F.encode(body, BYTES)
        text = F.when(F.col("_low_first"), F.decode(data, "UTF-16LE")).otherwise(F.decode(data, "UTF-16BE"))
        return whole.select("file", "block", "seq", byte_text(F.regexp_replace(text, "^﻿|\r$", "")).alias("raw"))
