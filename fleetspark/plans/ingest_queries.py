"""Queries on reading messy files; the lines are written by Spark from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fleetspark.functions import text as tx
from fleetspark.operators import dictionary as dic
from fleetspark.params import ReaderParams
from fleetspark.plans.registry import query
from fleetspark.plans.views import UNIT_SQL, raw_events, table
from fleetspark.session import shared_folder, stored
from fleetspark.sinks import tables as sinks
from fleetspark.sources import files as fl
from fleetspark.sources import ingest as ing
from fleetspark.sources import records
from fleetspark.sources.lines import byte_text, java_charsets

FULL_WIDTH = ("0123456789.", "０１２３４５６７８９．")


def event_lines(spark, sf):
    """One file per unit and day: two title lines, header, unit row, one line per event.

    Values below 1 are empty cells, every third is in full-width digits; ids have
    thousands separators in quotes.
    """
    ev = raw_events(spark, sf)
    number = F.substr("entity", F.lit(2), F.lit(2))
    path = F.concat(F.lit("/site/"), F.lpad(number, 3, "0"), F.lit("_PCS_"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".csv"))
    value = F.when(F.col("value") < 1, "").when(
        F.col("row_no") % 3 == 0, F.translate(F.col("value").cast("string"), *FULL_WIDTH)).otherwise(F.col("value").cast("string"))
    stamp = F.date_format("ts", "yyyy年M月d日 HH:mm:ss.SSSSSS")
    shown_id = F.concat(F.lit('"'), F.format_number(F.col("row_no"), 0), F.lit('"'))
    data = ev.select(
        path.alias("file"), (F.col("row_no") + 10).alias("seq"),
        F.concat_ws(",", stamp, value, shown_id, F.col("metric")).alias("line"))
    top = F.explode(F.array(*[
        F.struct(F.lit(i).cast("long").alias("seq"), F.lit(line).alias("line")) for i, line in enumerate(
            ["PCS監視データ出力", "出力 2024", "計測日時,発電(kW),ID,種別", ",kW,no,typ"])]))
    heads = data.select("file").distinct().select("file", top.alias("_t")).select("file", "_t.seq", "_t.line")
    lines = heads.unionByName(data)
    # as when files are read, a file's lines are together and the files are spread over the tasks
    lines = lines.repartition("file")
    # written once, as files are, since reading goes over them several times
    return stored(lines.select("file", F.lit(0).cast("long").alias("block"), "seq", byte_text(F.col("line")).alias("raw")))


@query("ingest_readings", f"""
  SELECT 'PCS0' || substr({UNIT_SQL}, 2) AS entity, strftime(ts, '%Y-%m-%d') AS day,
         strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, m.metric,
         CASE m.metric WHEN '発電(kW)' THEN CASE WHEN value >= 1 THEN value END WHEN 'ID' THEN event_id::DOUBLE END AS value,
         CASE WHEN m.metric = '種別' THEN event_type END AS text
  FROM events CROSS JOIN (VALUES ('発電(kW)'), ('ID'), ('種別')) m(metric)""")
def ingest_readings(spark, sf):
    out = ing.ingest(spark, event_lines(spark, sf)).readings
    return out.select("entity", F.date_format("day", "yyyy-MM-dd").alias("day"),
                      F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "metric", "value", "text")


@query("ingest_files", f"""
  SELECT 'PCS0' || substr({UNIT_SQL}, 2) AS entity, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_rows, 4 AS n_cols, 2 AS n_numeric,
         1 AS n_text, '計測日時' AS time_column, 'utf-8-sig' AS encoding, ',' AS delimiter, 2 AS header_row,
         'unit row detected below the header' AS notes FROM events GROUP BY 1, 2""")
def ingest_files(spark, sf):
    out = ing.ingest(spark, event_lines(spark, sf)).files
    return out.select("entity", F.date_format("day", "yyyy-MM-dd").alias("day"), "n_rows", "n_cols", "n_numeric", "n_text", "time_column",
                      "encoding", "delimiter", "header_row", F.array_join("notes", "; ").alias("notes"))


@query("ingest_columns", f"""
  SELECT DISTINCT {UNIT_SQL} AS unit, strftime(ts, '%Y-%m-%d') AS day, idx, raw, unit_row, is_time, is_numeric
  FROM events CROSS JOIN (VALUES (0, '計測日時', NULL, true, false), (1, '発電(kW)', 'kW', false, true), (2, 'ID', 'no', false, true),
    (3, '種別', 'typ', false, false)) c(idx, raw, unit_row, is_time, is_numeric)""")
def ingest_columns(spark, sf):
    out = ing.ingest(spark, event_lines(spark, sf)).columns
    stem = F.col("file")
    return out.select(F.concat(F.lit("U"), F.substr(stem, F.lit(8), F.lit(2))).alias("unit"),
                      F.substr(stem, F.lit(15), F.lit(10)).alias("day"), "idx", "raw", "unit_row", "is_time", "is_numeric")


def unit_files(spark, sf, before, cells, charset="UTF-8"):
    """One file per unit and day: the lines of ``before`` and a header, then ``cells`` of the events, in the bytes of ``charset``."""
    ev = raw_events(spark, sf)
    path = unit_path()
    data = ev.select(path.alias("file"), (F.col("row_no") + 100_000).alias("seq"), F.concat_ws(",", *cells).alias("line"))
    top = [(i, text) for i, text in enumerate([*before, "time,power,status"])]
    heads = data.select("file").distinct().select("file", F.explode(F.array(*[
        F.struct(F.lit(i).cast("long").alias("seq"), F.lit(text).alias("line")) for i, text in top])).alias("_t")).select("file", "_t.seq", "_t.line")
    lines = heads.unionByName(data)
    with java_charsets(spark):
        raw = F.decode(F.encode("line", charset), "ISO-8859-1")
        return lines.select("file", F.lit(0).cast("long").alias("block"), "seq", raw.alias("raw"))


def unit_path():
    return F.concat(F.lit("/units/"), F.date_format("ts", "yyyy-MM-dd"), F.lit("/"), "entity", F.lit(".csv"))


UNIT_FILE_SQL = f"""SELECT {UNIT_SQL} AS entity, event_id, metric, CASE metric WHEN 'power' THEN value END AS value,
    CASE metric WHEN 'status' THEN {{status}} END AS text FROM events CROSS JOIN (VALUES ('power'), ('status')) m(metric)"""


def with_event(out):
    return out.select("entity", (F.col("row_no") - 100_000).alias("event_id"), "metric", "value", "text")


@query("ingest_late_encoding", UNIT_FILE_SQL.format(
    status=f"CASE WHEN event_id = max(event_id) OVER (PARTITION BY {UNIT_SQL}, ts::DATE, metric) THEN '停止中' ELSE event_type END"))
def ingest_late_encoding(spark, sf):
    """Only the last line of each file tells its encoding."""
    last = raw_events(spark, sf).groupBy(unit_path().alias("file")).agg((F.max("row_no") + 100_000).alias("last"))
    lines = unit_files(spark, sf, [], (F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col("value").cast("string"), F.col("metric")))
    with java_charsets(spark):
        told = F.concat(F.regexp_replace("raw", "[^,]*$", ""), F.decode(F.encode(F.lit("停止中"), "windows-31j"), "ISO-8859-1"))
        lines = lines.join(last, "file").select("file", "block", "seq", F.when(F.col("seq") == F.col("last"), told).otherwise(F.col("raw")).alias("raw"))
    return with_event(ing.ingest(spark, lines).readings)


@query("ingest_skip_rows", UNIT_FILE_SQL.format(status="event_type"))
def ingest_skip_rows(spark, sf):
    """The header stands far below the top."""
    lines = unit_files(spark, sf, [f"note {i}" for i in range(1500)], (F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col("value").cast("string"), F.col("metric")))
    return with_event(ing.ingest(spark, lines, ReaderParams(skip_rows=1500)).readings)


@query("ingest_late_data", UNIT_FILE_SQL.format(status="event_type"))
def ingest_late_data(spark, sf):
    """The header stands far below the top, and nobody says where."""
    notes = [f"note {i}" if i % 400 else f"2024-01-{1 + i // 400:02d},{i}" for i in range(1, 900)]
    lines = unit_files(spark, sf, notes, (F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col("value").cast("string"), F.col("metric")))
    return with_event(ing.ingest(spark, lines).readings)


SPLIT = 1 << 20


@query("ingest_line_breaks", f"""
  SELECT {UNIT_SQL} AS entity, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, m.metric, CASE m.metric WHEN 'power' THEN value END AS value,
    CASE m.metric WHEN 'note' THEN event_type || chr(10) || 'no. ' || event_id || ', said "' || event_type || '"' END AS text
  FROM events CROSS JOIN (VALUES ('power'), ('note')) m(metric)""")
def ingest_line_breaks(spark, sf):
    """Every event is two lines, since its last cell holds a line break; splits begin anywhere."""
    ev = raw_events(spark, sf)
    first = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col("value").cast("string"), F.concat(F.lit('"'), "metric"))
    second = F.concat(F.lit("no. "), F.col("row_no").cast("string"), F.lit(', said ""'), "metric", F.lit('"""'))
    both = F.posexplode(F.array(first, second))
    data = ev.select(unit_path().alias("file"), "row_no", both.alias("i", "raw")).withColumn("seq", 2 * F.col("row_no") + F.col("i") + 10)
    heads = data.select("file").distinct().select("file", F.lit(0).cast("long").alias("seq"), F.lit("time,power,note").alias("raw"))
    lines = heads.unionByName(data.select("file", "seq", "raw"))
    out = ing.ingest(spark, lines.select("file", (F.expr("seq div 777") * SPLIT).alias("block"), "seq", "raw")).readings
    return out.select("entity", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "metric", "value", "text")


@query("utf16_lines", f"SELECT {UNIT_SQL} AS file, event_type || 'Ċ' || event_id || '਀' AS line FROM events")
def utf16_lines(spark, sf):
    """Lines of UTF-16 whose characters hold the byte of a line feed, from the pieces between such bytes."""
    ev = raw_events(spark, sf)
    first = ev.groupBy("entity").agg(F.min("row_no").alias("first"))
    line = F.concat("metric", F.lit("Ċ"), F.col("row_no").cast("string"), F.lit("਀\n"))
    with java_charsets(spark):
        data = F.decode(F.encode(line, "UTF-16LE"), "ISO-8859-1")
        # the second half of a line feed stands before the next line
        begun = F.concat(F.when(F.col("row_no") == F.col("first"), "ÿþ").otherwise("\0"), data)
        pieces = ev.join(first, "entity").select(F.col("entity").alias("file"), "row_no", F.posexplode(F.split(begun, "\n")).alias("i", "raw"))
    pieces = pieces.where((F.col("i") < 2) | (F.col("raw") != "\0")).select(
        "file", (F.expr("row_no div 500") * SPLIT).alias("block"), (F.col("row_no") * 16 + F.col("i")).alias("seq"), "raw")
    out = records.utf16_lines(pieces)
    return out.select("file", F.decode(F.encode("raw", "ISO-8859-1"), "UTF-8").alias("line"))


@query("file_faults", f"""
  WITH l AS (SELECT {UNIT_SQL} AS path, event_type, value, length(event_type) + 1 AS n, event_id FROM events),
  r AS (SELECT path, sum(n) AS length, sum(n - 1) FILTER (path < 'U05' OR event_id % 9 <> 0) AS got, count(*) FILTER (path < 'U05' OR event_id % 9 <> 0) AS lines
    FROM l GROUP BY path)
  SELECT path, length, CASE WHEN got + 2 * lines + 3 < length THEN 'only ' || got || ' of ' || length || ' bytes could be read' END AS fault FROM r""")
def file_faults(spark, sf):
    """Units of which every ninth line is missing are told from the others by their bytes."""
    ev = raw_events(spark, sf).withColumn("path", F.col("entity"))
    listing = ev.groupBy("path").agg(F.sum(F.length("metric") + 1).alias("length"))
    there = ev.where((F.col("path") < "U05") | (F.col("row_no") % 9 != 0))
    read = there.groupBy(F.col("path").alias("file")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("metric")).alias("n_bytes"))
    return ing.faults(listing, read, spark.createDataFrame([], "file string, size bigint"))


@query("period_days", f"""
  SELECT {UNIT_SQL} AS entity, event_type AS metric, count(*) AS rows, round(sum(value), 3) AS total FROM events
  WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-09 18:00:00' GROUP BY 1, 2""")
def period_days(spark, sf):
    """Readings written by their day, of which a period opens its days only."""
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    sinks.write_by_date(raw_events(spark, sf), path)
    found = sinks.read_by_date(spark, path, "2024-01-05 06:00:00", "2024-01-09 18:00:00")
    return found.groupBy("entity", "metric").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 3).alias("total"))


def part_cells(spark, sf):
    """A dictionary file per type of part: brands and parts as two tables side by side, under a title row."""
    part = table(spark, sf, "part")
    code = F.replace("p_brand", F.lit("#"), F.lit("_"))
    shared = F.when(F.col("p_partkey") % 4 == 0, "全号機 共通").otherwise("")
    number = F.expr("cast(substring(p_brand, 7) as int)")
    unit = F.when(F.col("p_partkey") % 2 == 0, "-").otherwise("kWh")

    def cells(row, first, *texts):
        return F.explode(F.array(*[F.struct(row.cast("int").alias("row"), F.lit(first + i).alias("col"), t.alias("text"))
                                   for i, t in enumerate(texts)])).alias("_c")

    file = F.col("p_type").alias("file")
    titles = ["CSV名称", "項目名称", "単位", "計測値種別", "CSV名称", "項目名称", "単位", "備考"]
    top = part.select(file).distinct().select("file", F.explode(F.array(
        F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit("部品").alias("text")),
        *[F.struct(F.lit(1).alias("row"), F.lit(i).alias("col"), F.lit(t).alias("text")) for i, t in enumerate(titles)])).alias("_c"))
    brands = part.select(file, code.alias("code"), number.alias("no")).distinct().select(
        "file", cells(F.col("no") + 2, 0, F.col("code"), F.concat(F.lit("名 "), "code", F.lit(" (V)")), F.lit("--"), F.lit("瞬時値")))
    parts = part.select(file, cells(F.col("p_partkey") + 2, 4, F.concat(F.lit("P_"), F.col("p_partkey").cast("string")),
                                    F.col("p_name"), unit, shared))
    return top.unionByName(brands).unionByName(parts).select("file", "_c.row", "_c.col", "_c.text")


@query("dictionary_entries", """
  SELECT DISTINCT p_type AS file, replace(p_brand, '#', '_') AS key, '名 ' || replace(p_brand, '#', '_') AS name, 'V' AS unit,
         '' AS note, '瞬時値' AS kind, false AS shared FROM part
  UNION ALL SELECT p_type, 'P_' || p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'kWh' END,
         CASE WHEN p_partkey % 4 = 0 THEN '全号機 共通' ELSE '' END, '', p_partkey % 4 = 0 FROM part""")
def dictionary_entries(spark, sf):
    rows = dic.entries(dic.extract_entries(part_cells(spark, sf)))
    return rows.select("file", "key", "name", "unit", "note", "kind", "shared")


@query("dictionary_blocks", """
  SELECT DISTINCT p_type AS file, block, key_col, name_col, unit_col, kind_col, note_col FROM part
  CROSS JOIN (VALUES (1, 0, 1, 2, 3, NULL), (2, 4, 5, 6, NULL, 7)) b(block, key_col, name_col, unit_col, kind_col, note_col)""")
def dictionary_blocks(spark, sf):
    out = dic.blocks(part_cells(spark, sf))
    return out.select("file", F.col("block").cast("int").alias("block"), "key_col", "name_col", "unit_col", "kind_col", "note_col")


# --- files ------------------------------------------------------------------------- #
def part_files(spark, sf):
    """File names from parts: own outputs, the same day twice, Office leftovers."""
    k = F.col("p_partkey")
    name = (F.when(k % 7 == 0, F.concat(F.lit("PCS"), k.cast("string"), F.lit("_cleaned.csv")))
            .when(k % 7 == 1, F.concat(F.lit("pcs"), (k - 1).cast("string"), F.lit(".txt")))
            .when(k % 7 == 2, F.concat(F.lit("pcs"), (k - 2).cast("string"), F.lit(".csv")))
            .when(k % 7 == 3, F.concat(F.lit("out/pcs"), k.cast("string"), F.lit(".csv")))
            .otherwise(F.concat(F.lit("PCS"), k.cast("string"), F.lit(".csv"))))
    return fl.describe_paths(table(spark, sf, "part").select(F.concat(F.lit("/data/"), name).alias("path"), k.alias("pos")))


@query("file_eligibility", """
  SELECT CASE k % 7 WHEN 0 THEN '/data/PCS' || k || '_cleaned.csv' WHEN 1 THEN '/data/pcs' || (k - 1) || '.txt'
           WHEN 2 THEN '/data/pcs' || (k - 2) || '.csv' WHEN 3 THEN '/data/out/pcs' || k || '.csv' ELSE '/data/PCS' || k || '.csv' END AS path,
         CASE WHEN k = 12 THEN 'this is the dictionary' WHEN k % 7 = 0 THEN 'previous output'
           WHEN k % 7 = 2 THEN 'same data as pcs' || (k - 2) || '.txt' WHEN k % 7 = 3 THEN 'in the output folder' END AS skip_reason
  FROM (SELECT p_partkey AS k FROM part)""")
def file_eligibility(spark, sf):
    return fl.eligible(part_files(spark, sf), "/data/PCS12.csv", "_cleaned", "/data/out").select("path", "skip_reason")


@query("natural_file_order", """
  SELECT p_partkey, substr('abc', (p_partkey % 3)::INT + 1, 1) || 'file|' || lpad(nullif(p_partkey, 0)::VARCHAR, 40, '0') || '|.csv' AS key
  FROM part WHERE p_partkey > 0 UNION ALL SELECT 0, 'afile|' || repeat('0', 40) || '|.csv'""")
def natural_file_order(spark, sf):
    k = F.col("p_partkey")
    name = F.concat(F.substr(F.lit("aBc"), (k % 3).cast("int") + 1, F.lit(1)), F.lit("File"), k.cast("string"), F.lit(".csv"))
    out = fl.natural_order(table(spark, sf, "part").select("p_partkey", name.alias("name")))
    return out.select("p_partkey", F.array_join(fl.natural_key("name"), "|").alias("key"))


# --- text functions ------------------------------------------------------------------- #
@query("to_number", """
  SELECT event_id, CASE event_id % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 3 THEN -value ELSE value END AS number FROM events""")
def to_number(spark, sf):
    v, k = F.col("value").cast("string"), F.col("event_id") % 6
    cell = (F.when(k == 0, F.concat(F.lit("　 "), v, F.lit(" "))).when(k == 1, F.translate(v, *FULL_WIDTH))
            .when(k == 2, F.concat(F.lit("0,0"), v)).when(k == 3, F.concat(F.lit("－"), v))
            .when(k == 4, "***").otherwise(F.concat(v, F.lit("d"))))
    return table(spark, sf, "events").select("event_id", tx.to_number(cell).alias("number"))


@query("parse_timestamp", """
  SELECT event_id, CASE event_id % 7 WHEN 6 THEN NULL WHEN 0 THEN strftime(ts, '%Y-%m-%d 00:00:00') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:00')
    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""")
def parse_timestamp(spark, sf):
    k = F.col("event_id") % 7

    def form(p):
        return F.date_format("ts", p)

    cell = (F.when(k == 0, form("yyyy/M/d")).when(k == 1, form("yyyy/MM/dd H:mm")).when(k == 2, form("yyyy年MM月dd日 HH時mm分ss秒"))
            .when(k == 3, F.replace(form("yyyy-MM-dd HH:mm:ss"), F.lit(":"), F.lit("："))).when(k == 4, form("yyyy-MM-dd'T'HH:mm:ss"))
            .when(k == 5, F.translate(form("yyyy/MM/dd HH:mm:ss"), *FULL_WIDTH)).otherwise(F.concat(F.lit("計 "), form("HH:mm"))))
    return table(spark, sf, "events").select(
        "event_id", F.date_format(tx.parse_timestamp(cell), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("timestamp_forms", """
  SELECT event_id, CASE event_id % 6 WHEN 4 THEN strftime(ts, '%Y-%m-%d %H:%M:00') WHEN 5 THEN strftime(ts, '%Y-%m-%d %H:00:00')
    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""")
def timestamp_forms(spark, sf):
    """Offsets from UTC and half days: times are local as they are written."""
    k = F.col("event_id") % 6
    iso, half = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format("ts", "a")
    cell = (F.when(k == 0, F.concat(iso, F.lit("+09:00"))).when(k == 1, F.concat(iso, F.lit("Z"))).when(k == 2, F.concat(iso, F.lit(".250-0530")))
            .when(k == 3, F.concat(F.date_format("ts", "yyyy/M/d h:mm:ss "), half)).when(k == 4, F.concat(F.date_format("ts", "yyyy/M/d h:mm"), F.lower(half)))
            .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd h "), half)))
    return table(spark, sf, "events").select("event_id", F.date_format(tx.parse_timestamp(cell), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("unit_signs", """
  SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false ELSE false END AS unit_like FROM part""")
def unit_signs(spark, sf):
    """Signs that stand for a whole unit."""
    k = F.col("p_partkey") % 5
    cell = F.when(k == 0, "W/\u33a1").when(k == 1, "\u33be").when(k == 2, "\u339e").when(k == 3, "--").otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", tx.looks_like_unit(cell).alias("unit_like"))


@query("normalize_headers", """
  SELECT p_partkey, lower(replace(p_name, ' ', '') || replace(p_brand, '#', '') || p_size) AS norm, p_name || ' ' || p_size AS name,
         CASE WHEN p_partkey % 2 = 0 THEN 'kW' ELSE '' END AS unit, p_partkey % 2 = 0 AS unit_like FROM part""")
def normalize_headers(spark, sf):
    part = table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    messy = F.concat(F.lit("［"), F.upper("p_name"), F.lit("］_・"), F.replace("p_brand", F.lit("#"), F.lit(" - ")),
                     F.lit("/"), F.translate(size, *FULL_WIDTH))
    even = F.col("p_partkey") % 2 == 0
    header = F.concat("p_name", F.lit(" "), size, F.when(even, "（kW）").otherwise("[+09:00]"))
    split = tx.split_unit(header)
    return part.select(
        "p_partkey", tx.normalize(messy).alias("norm"),
        F.regexp_replace(split["name"], r"\[\+09:00\]$", "").alias("name"), split["unit"].alias("unit"),
        tx.looks_like_unit(F.when(even, "kWh").otherwise(F.col("p_name"))).alias("unit_like"))


@query("strip_entity", """
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'PCS' || p_partkey WHEN 2 THEN 'x' || 'pcs' || p_partkey || ' ' || p_name
    ELSE ltrim(p_size::VARCHAR || p_name) END AS name FROM part""")
def strip_entity(spark, sf):
    """With a prefix and signs behind it, nothing but the prefix, the prefix in the middle, and a number that goes on."""
    k, prefix = F.col("p_partkey") % 4, F.concat(F.lit("pcs"), F.col("p_partkey").cast("string"))
    name = (F.when(k == 0, F.concat(F.lit(" "), F.upper(prefix), F.lit(" ： - "), "p_name")).when(k == 1, F.upper(prefix))
            .when(k == 2, F.concat(F.lit("x"), prefix, F.lit(" "), "p_name")).otherwise(F.concat(F.upper(prefix), F.lit("_"), F.col("p_size").cast("string"), "p_name")))
    return table(spark, sf, "part").select("p_partkey", tx.strip_entity(name, prefix).alias("name"))


@query("json_safe", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN round(value / 7, 6) END AS value FROM events")
def json_safe(spark, sf):
    from fleetspark.operators.series import json_safe as safe

    k = F.col("event_id") % 3
    v = F.when(k == 0, F.col("value") / 7).when(k == 1, float("inf")).otherwise(float("nan"))
    return table(spark, sf, "events").select("event_id", safe(v).alias("value"))
