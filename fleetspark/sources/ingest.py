"""From messy exports to one table of readings.

Four passes, each over every file at once. The first sums up the lines of every file: valid encodings, numbers of delimiters,
open quotes, bytes. The second keeps the beginnings of the files, which hold the headers. The third counts, per file and
column, what the cells hold: numbers, times, times of day. The last makes readings; the decisions it needs are a row per file
and a row per distinct layout, so it moves no data between tasks while those stay small.

All rows decide. Where data begin behind the beginning that was kept, their place is looked for in the whole file; where the
time column of the beginning is not that of all rows, the file's columns are counted again.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspark.functions.text import (
    BRACKETS,
    SEPARATORS,
    cell_is_number,
    fold_width,
    is_clock,
    looks_like_time,
    looks_like_unit,
    normalize_text,
    parse_timestamp,
    time_of_day_us,
    to_number,
)
from fleetspark.functions.timefn import DAY_US, from_micros, micros
from fleetspark.operators.align import resample
from fleetspark.operators.ordered import sized
from fleetspark.params import (
    NOTE_CLOCK,
    NOTE_EMPTY,
    NOTE_MULTI_ROW,
    NOTE_POOR_TIME,
    NOTE_RESAMPLED,
    NOTE_UNIT_ROW,
    IdentityParams,
    ReaderParams,
)
from fleetspark.session import cut
from fleetspark.sources.files import describe_paths
from fleetspark.sources.lines import (
    BYTES,
    decode_line,
    encoding_tests,
    java_charsets,
    plain_path,
    read_lines,
    row_no,
)
from fleetspark.sources.records import ends_open, quoted_records, utf16_lines

#: Lines of a file in which its data are looked for first. Nothing depends on it but time.
FIRST_LOOK = 200
MAX_FILES_LOCAL = 200_000
BLANKS = " \t\r\f\u3000\u00a0"


@dataclass(frozen=True)
class Ingested:
    readings: DataFrame
    files: DataFrame
    columns: DataFrame


def holds_cells(reader: ReaderParams) -> Column:
    """Whether a line holds a character besides blanks, delimiters and quotes."""
    return F.btrim("raw", F.lit("".join(reader.delimiters) + ' \t\r\n"')) != ""


def line_facts(lines: DataFrame, reader: ReaderParams = ReaderParams()) -> DataFrame:
    """Per file, from all its lines: encoding, delimiter, open (whether a quoted cell is open at the end of a line), n_lines,
    n_bytes.

    The encoding is the first candidate in which every line is valid; a mark at the start decides. The delimiter is the
    candidate with the most fields in the most stable number over the lines that are not blank.
    """
    tests = encoding_tests("raw", reader.encodings)
    counts = [(F.length("raw") - F.length(F.replace("raw", F.lit(d), F.lit("")))).alias(f"_n{i}") for i, d in enumerate(reader.delimiters)]
    marks = {"utf-8-sig": F.col("raw").startswith("ï»¿"), "utf-16": F.col("raw").startswith("ÿþ") | F.col("raw").startswith("þÿ")}
    start = F.when(F.col("block") == 0, F.col("seq"))
    flags = [f"_ok{i}" for i in range(len(tests))] + [f"_mark{i}" for i in range(len(marks))] + [f"_open{i}" for i in range(len(counts))]
    per_kind = lines.groupBy("file", *counts).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(F.btrim("raw") != "").alias("_lines"), F.sum(F.length("raw")).alias("_bytes"), F.min(start).alias("_first"),
        *[F.bool_and(t).alias(f"_ok{i}") for i, t in enumerate(tests.values())],
        *[F.min(F.when(t, start)).alias(f"_mark{i}") for i, t in enumerate(marks.values())],
        *[F.bool_or(ends_open(F.col("raw"), d)).alias(f"_open{i}") for i, d in enumerate(reader.delimiters)])
    # a row for each candidate; what holds for the file as a whole goes with every one of them
    tried = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(d).alias("delimiter"), F.col(f"_n{i}").alias("n")) for i, d in enumerate(reader.delimiters)]))
    rest = ["_all", "_lines", "_bytes", "_first", *flags]
    kinds = per_kind.select("file", tried.alias("_t"), *rest).select("file", "_t.*", *rest)

    def merged(rows, *keys, own=()):
        told = [(F.min if f.startswith("_mark") else F.bool_and if f.startswith("_ok") else F.bool_or)(f).alias(f) for f in flags]
        return rows.groupBy(*keys).agg(*own, F.min("_first").alias("_first"), *told)

    sums = [F.sum(c).alias(c) for c in ("_all", "_lines", "_bytes")]
    by_number = merged(kinds, "file", "no", "delimiter", "n", own=sums)
    best_number = F.max_by(F.struct("n", F.col("_lines").alias("times")), F.struct(F.col("_lines"), -F.col("n"))).alias("_mode")
    by_candidate = merged(by_number, "file", "no", "delimiter", own=[best_number, F.max(F.when(F.col("_lines") > 0, F.col("n"))).alias("_most"), *sums])
    score = F.when(F.col("_most") > 0, F.col("_mode.n") * F.col("_mode.times") / F.col("_lines"))
    first = F.struct(F.lit(0).alias("no"), F.lit(reader.delimiters[0]).alias("delimiter"))
    best = F.max_by(F.struct("no", "delimiter"), F.when(score.isNotNull(), F.struct(score, -F.col("no"))))
    found = merged(by_candidate, "file", own=[F.coalesce(best, first).alias("_best"), *[F.max(c).alias(c) for c in ("_all", "_bytes")]])
    name = F.lit("latin-1")
    for i, candidate in reversed(list(enumerate(tests))):
        name = F.when(F.col(f"_ok{i}"), candidate).otherwise(name)
    for i, mark in enumerate(marks):
        name = F.when(F.coalesce(F.col(f"_mark{i}") == F.col("_first"), F.lit(False)), mark).otherwise(name)
    return found.select("file", name.alias("encoding"), F.col("_best.delimiter").alias("delimiter"),
                        F.get(F.array(*[F.col(f"_open{i}") for i in range(len(counts))]), F.col("_best.no")).alias("open"),
                        F.col("_all").alias("n_lines"), F.col("_bytes").alias("n_bytes"))


def whole_lines(lines: DataFrame, facts: DataFrame, reader: ReaderParams) -> DataFrame:
    """``lines`` with those of a quoted cell that holds line breaks as one. Files without such cells pass through."""
    opened = facts.where("open").select("file", "delimiter")
    if opened.isEmpty():
        return lines
    joined = cut(quoted_records(lines.join(opened, "file"), list(reader.delimiters)).drop("delimiter"))
    return lines.join(opened.select("file"), "file", "left_anti").unionByName(joined)


def heads(lines: DataFrame, reader: ReaderParams = ReaderParams(), most: Column | int | None = None) -> DataFrame:
    """The first lines of each file that hold anything: those that are skipped, those up to a given header, and ``FIRST_LOOK``
    more, or ``most``."""
    most = F.lit(reader.skip_rows + (reader.header_row or 0) + FIRST_LOOK) if most is None else most
    by_place = Window.partitionBy("file").orderBy("block", "seq")
    # a limit on row_number itself is applied in each task before the shuffle
    return lines.where(holds_cells(reader)).withColumn("_nth", F.row_number().over(by_place)).where(F.col("_nth") <= most)


def split_cells(line: Column, delimiter: Column, candidates: Sequence[str]) -> Column:
    """A line's cells, trimmed, empty ones null. Quotes may hold delimiters and doubled quotes."""
    out = F.array(line)
    for d in candidates:
        q = re.escape(d)
        plain = F.split(line, q, -1)
        pieces = F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(q + r'("(?:[^"]++|"")*"[^' + q + r']*|[^' + q + ']*)'), F.lit(1))
        bare = F.transform(pieces, lambda c: F.when(
            c.startswith('"'), F.replace(F.regexp_replace(F.regexp_replace(c, '^"', ""), '"(?!")([^"]*)$', "$1"), F.lit('""'), F.lit('"'))
        ).otherwise(c))
        out = F.when(delimiter == d, F.when(line.contains('"'), bare).otherwise(plain)).otherwise(out)
    return F.transform(out, lambda c: F.nullif(F.btrim(c, F.lit(BLANKS)), F.lit("")))


def filled(cells: str | Column) -> Column:
    return F.size(F.array_compact(F.col(cells) if isinstance(cells, str) else cells))


def is_data_row(cells: str = "cells") -> Column:
    """At least two filled cells, at least 60 % of them numbers or times."""
    hits = F.size(F.filter(cells, lambda c: cell_is_number(c) | looks_like_time(c)))
    return (filled(cells) >= 2) & (hits / F.greatest(filled(cells), F.lit(1)) >= 0.6)


def parse_head(head: DataFrame, facts: DataFrame, reader: ReaderParams) -> DataFrame:
    """Head rows as cells: file, r (0-based number of the row behind those skipped), block, seq, cells."""
    rows = cell_rows(head.join(facts.select("file", "encoding", "delimiter"), "file"), reader)
    place = F.row_number().over(Window.partitionBy("file").orderBy("_nth")) - 1 - reader.skip_rows
    return rows.where(filled("cells") > 0).withColumn("r", place).where(F.col("r") >= 0).select("file", "r", "block", "seq", "cells")


def cell_rows(lines: DataFrame, reader: ReaderParams) -> DataFrame:
    """Lines, with their encoding and delimiter, as cells."""
    rows = lines.withColumn("line", decode_line(known=reader.encodings))
    return rows.withColumn("cells", split_cells(F.col("line"), F.col("delimiter"), reader.delimiters)).drop("line", "raw")


def detect_layout(rows: DataFrame, reader: ReaderParams = ReaderParams()) -> DataFrame:
    """Per file ``header_row`` and ``data_start`` (numbers of non-blank rows), and whether data were ``found``.

    Data begin at the first data row that another one follows, or the end of ``rows``. Windows hold the head of one file.
    """
    head = Window.partitionBy("file")
    judged = rows.select("file", "r", filled("cells").alias("w"), is_data_row().alias("data"))
    if reader.header_row is not None:
        header = F.least(F.lit(max(0, reader.header_row)), F.max("r").over(head))
        body = F.min(F.when(F.col("data") & (F.col("r") > F.col("header_row")), F.col("r")))
        return judged.withColumn("header_row", header).groupBy("file", "header_row").agg(
            F.coalesce(body, F.max("r") + 1).alias("data_start"), body.isNotNull().alias("found"))
    again = F.coalesce(F.lead("data").over(head.orderBy("r")), F.lit(True))
    start = F.when(F.col("data") & F.col("_again"), F.col("r"))
    # the header block reaches up to the nearest row that is narrow or data
    wide = F.col("w") >= F.greatest(F.lit(2.0), F.col("_width") * 0.5)
    judged = (
        judged.withColumn("_again", again)
        .withColumn("_first", F.min(start).over(head))
        .withColumn("_width", F.max(F.when(F.col("r") == F.col("_first"), F.col("w"))).over(head))
        .withColumn("_stop", (F.col("r") < F.col("_first")) & (F.col("data") | ~wide))
    )
    found = judged.groupBy("file").agg(
        F.max("_first").alias("_first"), F.max(F.when(F.col("_stop"), F.col("r"))).alias("_stop"),
        F.min_by("r", F.struct(-F.col("w"), F.col("r"))).alias("_widest"))
    top = F.least(F.coalesce(F.col("_stop") + 1, F.lit(0)), F.col("_first") - 1)
    return found.select(
        "file",
        F.when(F.col("_first").isNull(), F.col("_widest")).when(F.col("_first") == 0, 0).otherwise(top).alias("header_row"),
        F.when(F.col("_first").isNull(), F.col("_widest") + 1).otherwise(F.col("_first")).alias("data_start"), F.col("_first").isNotNull().alias("found"))


def data_places(lines: DataFrame, files: DataFrame, reader: ReaderParams) -> DataFrame:
    """Where the data of ``files`` (file, encoding, delimiter) begin, looked for in all their rows: file, most, the number of
    lines up to and with the row behind the first data row. Files without data are left out. Windows hold a split of a file."""
    rows = cell_rows(lines.where(holds_cells(reader)).join(files, "file"), reader)
    inside, over = Window.partitionBy("file", "block").orderBy("seq"), Window.partitionBy("file").orderBy("block")
    judged = rows.select("file", "block", "seq", is_data_row().alias("data")).withColumn("_nth", F.row_number().over(inside))
    blocks = cut(judged).groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min_by("data", "seq").alias("_first"))
    blocks = blocks.select("file", "block", (F.sum("_n").over(over) - F.col("_n")).alias("_before"), F.lead("_first").over(over).alias("_next"))
    judged = judged.withColumn("_again", F.lead("data").over(inside)).join(blocks, ["file", "block"])
    place = F.col("_before") + F.col("_nth")
    if reader.header_row is not None:
        hit = F.col("data") & (place > reader.skip_rows + reader.header_row + 1)
    else:
        hit = F.col("data") & F.coalesce("_again", "_next", F.lit(True)) & (place > reader.skip_rows)
    return judged.where(hit).groupBy("file").agg((F.min(place) + 1).alias("most"))


def header_cells(rows: DataFrame, layouts: DataFrame) -> DataFrame:
    """Per file and column the header text, the unit-row text and further name rows: file, idx, head, unit_row, extra."""
    block = rows.join(layouts, "file").where(
        (F.col("r") >= F.col("header_row")) & ((F.col("r") < F.col("data_start")) | (F.col("r") == F.col("header_row"))))
    unitish = F.size(F.filter("cells", lambda c: c.isNotNull() & looks_like_unit(c) & ~cell_is_number(c)))
    block = block.withColumn("_unit", unitish / F.greatest(filled("cells"), F.lit(1)) > 0.5)
    cells = block.select("file", "r", "header_row", "_unit", F.posexplode("cells").alias("idx", "text"))
    below = F.col("r") > F.col("header_row")
    extra = F.array_sort(F.collect_list(F.when(
        below & ~F.col("_unit") & F.col("text").isNotNull(), F.struct("r", "text"))))
    return cells.groupBy("file", "idx").agg(
        F.max(F.when(~below, F.col("text"))).alias("head"),
        F.min_by("text", F.when(below & F.col("_unit") & F.col("text").isNotNull(), F.col("r"))).alias("unit_row"),
        F.transform(extra, lambda e: e["text"]).alias("extra"))


def column_names(header: DataFrame) -> DataFrame:
    """Adds ``raw``: blanks take the name to their left, ``col<i>`` if none, repeats get #1, #2, ..."""
    left_to_right = Window.partitionBy("file").orderBy("idx")
    last = F.last("head", True).over(left_to_right)
    text = F.trim(F.concat_ws(" ", F.coalesce("head", last), F.array_join(F.coalesce("extra", F.array().cast("array<string>")), " ")))
    named = header.withColumn("_text", F.when(text == "", F.concat(F.lit("col"), F.col("idx").cast("string"))).otherwise(text))
    nth = F.row_number().over(Window.partitionBy("file", "_text").orderBy("idx")) - 1
    return named.withColumn("_nth", nth).withColumn(
        "raw", F.when(F.col("_nth") > 0, F.concat_ws("#", "_text", F.col("_nth").cast("string"))).otherwise(F.col("_text"))
    ).drop("_text", "_nth")


def time_score(share: Column, raw: Column, identity: IdentityParams) -> Column:
    """How much a column looks like the time: the share of its cells that do, and a word in its name."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(F.trim(fold_width(raw)), BRACKETS, " ")), SEPARATORS, "")
    hinted = F.lit(False)
    for word in identity.time_candidates:
        hinted = hinted | plain.contains(normalize_text(word))
    return share + F.when(hinted, 0.35).otherwise(0.0)


def best_time(scored: DataFrame, identity: IdentityParams) -> DataFrame:
    """Per file the time column, of columns (file, idx, raw) with the ``_share`` of their cells that look like times."""
    scored = scored.withColumn("_score", time_score(F.col("_share"), F.col("raw"), identity))
    explicit = F.lit(None).cast("int")
    if identity.time_column:
        explicit = F.min(F.when(F.col("raw") == identity.time_column, F.col("idx")))
    best = F.max_by("idx", F.when(F.col("_score") >= 0.5, F.struct(F.col("_score"), -F.col("idx"))))
    return scored.groupBy("file").agg(F.coalesce(explicit, best).alias("time_idx"))


def detect_time(body_head: DataFrame, named: DataFrame, identity: IdentityParams) -> DataFrame:
    """Per file the time column as the head has it."""
    cells = body_head.select("file", F.posexplode("cells").alias("idx", "text")).where("text is not null")
    seen = cells.groupBy("file", "idx").agg(F.avg(looks_like_time("text").cast("double")).alias("_share"))
    return best_time(named.select("file", "idx", "raw").join(seen, ["file", "idx"]), identity)


def body_rows(lines: DataFrame, plan: DataFrame, reader: ReaderParams) -> DataFrame:
    """Data rows of every file as cells; ``plan`` has a row per file."""
    rows = lines.join(plan, "file").where(
        (F.col("block") > F.col("start_block")) | ((F.col("block") == F.col("start_block")) & (F.col("seq") >= F.col("start_seq"))))
    # a row without a filled cell is told by its characters, so that cells are split only once
    return cell_rows(rows.where(holds_cells(reader)), reader)


ROW = -1


def cell_statistics(body: DataFrame, reader: ReaderParams) -> DataFrame:
    """What each file's columns hold, over all rows and over rows whose time can be read.

    Column ``ROW`` stands for the rows themselves. One pass over the bodies.
    """
    ts = parse_timestamp(F.get("cells", F.col("time_idx")))
    row = F.array(F.struct(F.lit(ROW).alias("idx"), F.lit("").alias("text")))
    cells = F.transform("cells", lambda c, i: F.struct(i.alias("idx"), c.alias("text")))
    long = (
        body.withColumn("_ts", ts)
        .select("file", "_ts", F.explode(F.concat(row, cells)).alias("_c"))
        .select("file", "_ts", "_c.idx", "_c.text").where("text is not null")
    )
    long = long.withColumn("_number", to_number("text", reader).isNotNull()).withColumn("_clock", is_clock("text"))
    long = long.withColumn("_time", F.when(F.col("_number"), F.lit(False)).otherwise(looks_like_time("text")))
    number, dated = F.col("_number"), F.col("_ts").isNotNull()
    return long.groupBy("file", "idx").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(number).alias("n_numbers"),
        F.count_if(dated).alias("n_dated"), F.count_if(number & dated).alias("n_dated_numbers"),
        F.count_if("_clock").alias("n_clock"), F.count_if("_time").alias("n_time"),
        F.bool_and(F.pmod(micros("_ts"), F.lit(DAY_US)) < 60_000_000).alias("midnight"),
        F.min("_ts").alias("first_ts"))


def unit_cells(body: DataFrame) -> DataFrame:
    """The first filled cell of each file's unit column, by time."""
    unit = F.get("cells", F.col("entity_idx"))
    at = F.struct(parse_timestamp(F.get("cells", F.col("time_idx"))).alias("ts"), row_no().alias("row_no"))
    return body.select("file", unit.alias("_unit"), at.alias("_at")).where("_unit is not null").groupBy("file").agg(
        F.min_by("_unit", "_at").alias("entity_cell"))


def _from_stem(pattern: str) -> Column:
    group = 1 if re.compile(pattern).groups else 0
    return F.nullif(F.regexp_extract("stem", pattern, group), F.lit(""))


def identify(files: DataFrame, identity: IdentityParams) -> DataFrame:
    """Adds ``entity`` and ``day``: unit column, file name, source, stem; date in the name or first time."""
    options = [F.col("entity_cell")] if "entity_cell" in files.columns else []
    for pattern in (identity.entity_from_filename, identity.source_from_filename):
        if pattern:
            options.append(_from_stem(pattern))
    entity = F.coalesce(*options, F.col("stem"))
    if identity.entity_label:
        entity = F.when(entity.rlike(r"^\d+$"), F.concat(F.lit(identity.entity_label), entity)).otherwise(entity)
    day = F.to_date("first_ts")
    if identity.date_from_filename:
        found = F.try_to_date(F.replace(_from_stem(identity.date_from_filename), F.lit("_"), F.lit("-")), "yyyy-MM-dd")
        day = F.coalesce(found, day)
    return files.withColumn("entity", entity).withColumn("day", day)


def ingest(spark: SparkSession, lines: DataFrame, reader: ReaderParams = ReaderParams(),
           identity: IdentityParams = IdentityParams(), listing: DataFrame | None = None) -> Ingested:
    """Readings, files and columns of the exports in ``lines``.

    ``listing`` (path, ...) names all files, so that one without any line shows up with an error.
    """
    with java_charsets(spark):
        return _ingest(lines, reader, identity, listing)


def _ingest(lines: DataFrame, reader: ReaderParams, identity: IdentityParams, listing: DataFrame | None) -> Ingested:
    facts = sized(line_facts(lines, reader), MAX_FILES_LOCAL)
    lines = whole_lines(lines, facts, reader)
    rows = cut(parse_head(heads(lines, reader), facts, reader))
    layouts = sized(detect_layout(rows, reader), MAX_FILES_LOCAL)
    late = layouts.where(~F.col("found")).join(facts.where(F.col("n_lines") > FIRST_LOOK), "file").select("file", "encoding", "delimiter")
    if not late.isEmpty():
        # the beginnings of these files reach as far as their data are away
        places = sized(data_places(lines, late, reader), MAX_FILES_LOCAL)
        longer = heads(lines.join(places, "file"), reader, F.col("most")).drop("most")
        rows = cut(rows.join(places.select("file"), "file", "left_anti").unionByName(parse_head(longer, facts, reader)))
        layouts = sized(detect_layout(rows, reader), MAX_FILES_LOCAL)
    layouts = layouts.drop("found")
    header = header_cells(rows, layouts)
    named_head = cut(column_names(header))
    body_head = rows.join(layouts, "file").where(F.col("r") >= F.col("data_start"))
    starts = body_head.groupBy("file").agg(F.min(F.struct("block", "seq")).alias("_at")).select(
        "file", F.col("_at.block").alias("start_block"), F.col("_at.seq").alias("start_seq"))
    plan = facts.join(layouts, "file").join(starts, "file").join(detect_time(body_head, named_head, identity), "file", "left")
    if identity.entity_column:
        unit_idx = named_head.where(F.col("raw") == identity.entity_column).groupBy("file").agg(F.min("idx").alias("entity_idx"))
        plan = plan.join(unit_idx, "file", "left")
    plan = sized(plan, MAX_FILES_LOCAL)

    stats = cut(cell_statistics(body_rows(lines, plan, reader), reader))
    # all rows have a say in what is the time
    shares = stats.where(F.col("idx") != ROW).select("file", "idx", (F.col("n_time") / F.col("n")).alias("_share"))
    told = best_time(named_head.select("file", "idx", "raw").join(shares, ["file", "idx"]), identity)
    other = sized(plan.join(told.withColumnRenamed("time_idx", "_told"), "file", "left").where(~F.col("time_idx").eqNullSafe(F.col("_told"))).select(
        "file", "_told"), MAX_FILES_LOCAL)
    if not other.isEmpty():
        plan = sized(plan.join(other.withColumn("_other", F.lit(True)), "file", "left").withColumn(
            "time_idx", F.when(F.col("_other"), F.col("_told")).otherwise(F.col("time_idx"))).drop("_told", "_other"), MAX_FILES_LOCAL)
        again = cell_statistics(body_rows(lines, plan.join(other.select("file"), "file", "left_semi"), reader), reader)
        stats = cut(stats.join(other.select("file"), "file", "left_anti").unionByName(again))
    body = body_rows(lines, plan, reader)
    files = _file_table(plan, stats, unit_cells(body) if identity.entity_column else None, identity)
    files = sized(files, MAX_FILES_LOCAL)
    columns = sized(_column_table(named_head.drop("raw"), stats, files))
    readings = _readings(body, files, columns, reader)
    if identity.resample:
        readings = resample(readings, identity.resample).withColumn("row_no", F.lit(0).cast("long"))
    return Ingested(readings, _files_report(files, columns, listing, identity), columns)


def _file_table(plan: DataFrame, stats: DataFrame, units: DataFrame | None, identity: IdentityParams) -> DataFrame:
    """A row per file with every decision: time and clock column, unit, day."""
    rows = stats.where(F.col("idx") == ROW).select(
        "file", F.col("n").alias("n_all"), "n_dated", "midnight", "first_ts")
    cells = stats.where(F.col("idx") != ROW).groupBy("file").agg(
        F.array_sort(F.collect_list(F.when(F.col("n_clock") == F.col("n"), F.col("idx")))).alias("_clocks"), F.max("idx").alias("last_idx"))
    files = plan.join(rows, "file").join(cells, "file", "left")
    if units is not None:
        files = files.join(units, "file", "left")
    good = F.col("time_idx").isNotNull() & (F.col("n_dated") / F.col("n_all") >= 0.5)
    # the first column of nothing but times of day
    clock = F.get(F.filter("_clocks", lambda i: i != F.col("time_idx")), F.lit(0))
    files = (
        files.withColumn("parsed_share", F.when(F.col("time_idx").isNotNull(), F.col("n_dated") / F.col("n_all")))
        .withColumn("tried_idx", F.col("time_idx"))
        .withColumn("time_idx", F.when(good, F.col("time_idx")))
        .withColumn("clock_idx", F.when(good & F.col("midnight"), clock))
        .withColumn("first_ts", F.when(good, F.col("first_ts")))
        .withColumn("path", F.col("file")).drop("_clocks")
    )
    return identify(describe_paths(files), identity).drop("path", "folder", "suffix", "name")


def _column_table(header: DataFrame, stats: DataFrame, files: DataFrame) -> DataFrame:
    """Columns of every file: file, idx, raw, unit_row, is_time, is_numeric, empty ones marked by n = 0."""
    # rows may be wider than the header: every position up to the last filled one has a name
    places = files.select("file", F.explode(F.sequence(F.lit(0), F.coalesce("last_idx", F.lit(0)))).alias("idx"))
    every = places.join(header, ["file", "idx"], "full")
    named = column_names(every)
    dated = F.col("time_idx").isNotNull()
    n = F.when(dated, F.col("n_dated")).otherwise(F.col("n"))
    numbers = F.when(dated, F.col("n_dated_numbers")).otherwise(F.col("n_numbers"))
    return (
        named.join(stats.drop("midnight", "first_ts", "n_clock", "n_time"), ["file", "idx"], "left").fillna(0, ["n", "n_numbers", "n_dated", "n_dated_numbers"])
        .join(files.select("file", "time_idx"), "file")
        .withColumn("is_time", F.coalesce(F.col("idx") == F.col("time_idx"), F.lit(False)))
        .withColumn("is_numeric", ~F.col("is_time") & (n > 0) & (numbers / F.greatest(n, F.lit(1)) >= 0.8))
        .select("file", "idx", "raw", "unit_row", F.size(F.coalesce("extra", F.array().cast("array<string>"))).alias("n_extra"),
                "n", "is_time", "is_numeric")
    )


def _readings(body: DataFrame, files: DataFrame, columns: DataFrame, reader: ReaderParams) -> DataFrame:
    kept = columns.where((F.col("n") > 0) & ~F.col("is_time"))
    # files of one kind share their layout, so there are few distinct ones
    per_file = kept.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("idx", "raw", "is_numeric"))).alias("cols"))
    per_file = per_file.withColumn("layout", F.xxhash64(F.to_json("cols")))
    layouts = sized(per_file.groupBy("layout").agg(F.first("cols").alias("cols")))
    facts = sized(
        files.join(per_file.select("file", "layout"), "file")
        .select("file", "layout", "entity", "day", F.col("time_idx").alias("_time"), F.col("clock_idx").alias("_clock")),
        MAX_FILES_LOCAL)
    ts = parse_timestamp(F.get("cells", F.col("_time")))
    clock = from_micros(micros("_ts") - F.pmod(micros("_ts"), F.lit(DAY_US)) + time_of_day_us(F.get("cells", F.col("_clock"))))
    rows = (
        body.select("file", "block", "seq", "cells").join(facts, "file")
        .join(layouts, "layout")
        .withColumn("_ts", ts).withColumn("ts", F.when(F.col("_clock").isNotNull(), clock).otherwise(F.col("_ts")))
    )
    # without a time column the rows stay, with no time; with one, unreadable times are no rows. Said inside the
    # explode, since a filter would have the times parsed a second time
    kept = F.when(F.col("_time").isNull() | F.col("ts").isNotNull(), F.col("cols"))
    cell = F.explode(F.transform(kept, lambda c: F.struct(
        c["raw"].alias("metric"), c["is_numeric"].alias("is_numeric"), F.get(F.col("cells"), c["idx"]).alias("text"))))
    long = rows.select("file", "entity", "day", "ts", row_no().alias("row_no"), cell.alias("_c"))
    text = F.col("_c.text")
    return long.select(
        "file", "entity", "day", "ts", F.col("_c.metric").alias("metric"),
        F.when(F.col("_c.is_numeric"), to_number(text, reader)).alias("value"),
        F.when(~F.col("_c.is_numeric"), text).alias("text"), "row_no")


def _files_report(files: DataFrame, columns: DataFrame, listing: DataFrame | None, identity: IdentityParams) -> DataFrame:
    counts = columns.groupBy("file").agg(
        F.count_if(F.col("n") > 0).cast("int").alias("n_cols"),
        F.count_if("is_numeric").cast("int").alias("n_numeric"),
        F.count_if((F.col("n") > 0) & ~F.col("is_numeric") & ~F.col("is_time")).cast("int").alias("n_text"),
        F.count_if(F.col("n") == 0).cast("int").alias("_empty"),
        F.count(F.when(F.col("unit_row").isNotNull(), 1)).alias("_units"), F.sum("n_extra").alias("_extra"),
        F.max(F.when(F.col("is_time"), F.col("raw"))).alias("time_column"),
        F.map_from_entries(F.collect_list(F.struct("idx", "raw"))).alias("_names"))
    out = files.join(counts, "file", "left")
    name = F.element_at("_names", F.col("tried_idx"))
    clock = F.element_at("_names", F.col("clock_idx"))
    notes = F.array_compact(F.array(
        F.when(F.col("_units") > 0, NOTE_UNIT_ROW),
        F.when(F.col("_extra") > 0, NOTE_MULTI_ROW),
        F.when(F.col("_empty") > 0, F.format_string(NOTE_EMPTY, "_empty")),
        F.when(F.col("tried_idx").isNotNull() & F.col("time_idx").isNull(), F.format_string(
            NOTE_POOR_TIME, name, F.round(F.col("parsed_share") * 100, 0).cast("int"))),
        F.when(F.col("clock_idx").isNotNull(), F.format_string(NOTE_CLOCK, clock)),
        F.lit(NOTE_RESAMPLED % identity.resample) if identity.resample else F.lit(None).cast("string"),
    ))
    out = out.select(
        "file", "entity", "day", F.when(F.col("time_idx").isNotNull(), F.col("n_dated")).otherwise(F.col("n_all")).alias("n_rows"),
        "n_cols", "n_numeric", "n_text", "time_column", "encoding", "delimiter", "header_row",
        notes.alias("notes"), F.lit(None).cast("string").alias("error"))
    if listing is None:
        return out
    if "fault" not in listing.columns:
        listing = listing.withColumn("fault", F.lit(None).cast("string"))
    missing = listing.select(F.col("path").alias("file"), "fault").join(out, "file", "left_anti")
    empty = missing.select("file", *[F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema.fields[1:-1]],
                           F.coalesce("fault", F.lit("file is empty or has no data rows")).alias("error"))
    return out.unionByName(empty)


def faults(listing: DataFrame, read: DataFrame, inflated: DataFrame) -> DataFrame:
    """``listing`` (path, length) and fault, for files of which less was read than they hold.

    ``read`` has a file's n_lines and n_bytes, without the one or two bytes that end a line and a mark of three at its start. Of
    compressed files ``inflated`` (file, size) says how much they hold.
    """
    known = listing.select("path", "length", F.col("path").alias("file")).join(read, "file", "left").join(inflated, "file", "left")
    packed = F.col("path").rlike(r"(?i)\.(gz|bz2|zst|xz|lz4|snappy|deflate)$")
    whole = F.coalesce("size", F.when(~packed, F.col("length")))
    short = F.coalesce("n_bytes", F.lit(0)) + 2 * F.coalesce("n_lines", F.lit(0)) + 3 < whole
    said = F.concat(F.lit("only "), F.coalesce("n_bytes", F.lit(0)).cast("string"), F.lit(" of "), whole.cast("string"), F.lit(" bytes could be read"))
    unread = F.col("n_lines").isNull() & (F.col("length") > 0)
    return known.select("path", "length", F.when(short, said).when(unread, "file could not be read").alias("fault"))


def inflated_sizes(spark: SparkSession, listing: DataFrame) -> DataFrame:
    """What files of gzip say that they hold, from their last four bytes: file, size. Only such files are opened."""
    if listing.where(F.lower("path").endswith(".gz")).isEmpty():
        return spark.createDataFrame([], "file string, size bigint")
    paths = [r["path"] for r in listing.where(F.lower("path").endswith(".gz")).select("path").collect()]
    found = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").load(paths)
    last = F.hex(F.encode(F.reverse(F.decode(F.expr("substring(content, -4, 4)"), BYTES)), BYTES))
    return found.select(plain_path(F.col("_metadata.file_path")).alias("file"), F.conv(last, 16, 10).cast("long").alias("size"))


def ingest_files(spark: SparkSession, paths: Sequence[str], reader: ReaderParams = ReaderParams(),
                 identity: IdentityParams = IdentityParams(), listing: DataFrame | None = None) -> Ingested:
    """Reads and ingests files, all of them in splits.

    A file that cannot be read, or only in part, gives no readings but a row with an error; the others are not touched by it.
    """
    lines = read_lines(spark, list(paths), faults=True)
    if listing is None:
        listing = spark.read.format("binaryFile").load(list(paths)).select(plain_path(F.col("_metadata.file_path")).alias("path"), "length")
    marked = F.col("raw").startswith("ÿþ") | F.col("raw").startswith("þÿ")
    seen = lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("raw")).alias("n_bytes"),
        F.min(F.when(F.col("block") == 0, F.col("seq"))).alias("_first"), F.min(F.when((F.col("block") == 0) & marked, F.col("seq"))).alias("_marked"))
    seen = sized(seen.select("file", "n_lines", "n_bytes", F.coalesce(F.col("_first") == F.col("_marked"), F.lit(False)).alias("wide")), MAX_FILES_LOCAL)
    listing = sized(faults(listing, seen.drop("wide"), inflated_sizes(spark, listing)), MAX_FILES_LOCAL)
    bad = listing.where("fault IS NOT NULL").select(F.col("path").alias("file"))
    if not bad.isEmpty():
        lines = lines.join(bad, "file", "left_anti")
    # paths to read, as in any listing
    found = [r["file"] for r in seen.where("wide").join(bad, "file", "left_anti").select("file").collect()]
    if not found:
        return ingest(spark, lines, reader, identity, listing)
    wide = cut(utf16_lines(read_lines(spark, found, breaks="\n", faults=True)))
    lines = lines.join(seen.where("wide").select("file"), "file", "left_anti").unionByName(wide)
    out = ingest(spark, lines, reader, identity, listing)
    encoding = F.when(F.col("file").isin(*found), "utf-16").otherwise(F.col("encoding"))
    return replace(out, files=out.files.withColumn("encoding", encoding))


def dictionary_cells(spark: SparkSession, lines: DataFrame, reader: ReaderParams = ReaderParams()) -> DataFrame:
    """Dictionary files as cells: file, row, col, text. Blank lines are no rows."""
    with java_charsets(spark):
        facts = sized(line_facts(lines, reader), MAX_FILES_LOCAL)
        text = whole_lines(lines, facts, reader).where(F.btrim("raw") != "")
        text = text.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("block", "seq")) - 1)
        rows = cell_rows(text.join(facts.select("file", "encoding", "delimiter"), "file"), reader)
        return rows.select("file", F.col("r").alias("row"), F.posexplode("cells").alias("col", "text"))
