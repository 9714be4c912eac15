"""Queries on what is written and reported: listings, files of units, tables as CSV, limits, roles, shared sensors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fleetspark.operators import align, diagnostics, rules, summaries
from fleetspark.operators.reshape import tidy
from fleetspark.params import PLANT, ReaderParams, Rule
from fleetspark.plans.fleet_queries import DF
from fleetspark.plans.ingest_queries import UNIT_FILE_SQL, part_files, unit_files, with_event
from fleetspark.plans.registry import query
from fleetspark.plans.views import (
    CHANNELS_SQL,
    EV_SQL,
    UNIT_SQL,
    channels,
    day_files,
    fleet_channels,
    raw_events,
    readings,
    readings_sql,
    table,
)
from fleetspark.session import shared_folder, stored
from fleetspark.sinks import tables as sinks
from fleetspark.sources import files as fl
from fleetspark.sources import ingest as ing

RD = readings_sql()


def new_folder(spark):
    return f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"


# --- listings ------------------------------------------------------------------------- #
@query("discover_files", f"""
  SELECT 'entity=' || {UNIT_SQL} AS folder, count(DISTINCT event_type) AS files FROM events GROUP BY 1""")
def discover_files(spark, sf):
    """Exports of units, a file for each channel, found again in their folders."""
    path = new_folder(spark)
    lines = raw_events(spark, sf).select("entity", "metric", F.concat_ws(",", "ts", "value").alias("line"))
    lines.repartition("entity", "metric").write.partitionBy("entity", "metric").text(path)
    found = fl.discover(spark, path, ("*.txt",))
    pos = found.agg(F.min("pos"), F.max("pos"), F.countDistinct("pos"), F.count(F.lit(1))).first()
    if (pos[0], pos[1], pos[2]) != (1, pos[3], pos[3]):
        raise ValueError("places of files are not 1, 2, ...")
    unit = F.element_at(F.split("folder", "/"), -2)
    kinds = found.select(unit.alias("folder"), F.element_at(F.split("folder", "/"), -1).alias("metric")).distinct()
    return kinds.groupBy("folder").agg(F.count(F.lit(1)).alias("files"))


@query("dictionary_file", """
  WITH l AS (SELECT 'd' || (p_size % 3) AS folder, CASE p_partkey % 5 WHEN 0 THEN 'Columns' WHEN 1 THEN 'mapping' WHEN 2 THEN '~$dict' ELSE 'part' END || p_partkey AS stem,
      CASE p_partkey % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'xls' WHEN 2 THEN 'txt' ELSE 'xlsx' END AS suffix, p_partkey % 5 AS k FROM part)
  SELECT '/' || folder || '/' || stem || '.' || suffix AS path FROM l WHERE k < 2 AND suffix <> 'txt'
  ORDER BY CASE folder WHEN 'd2' THEN 0 WHEN 'd1' THEN 1 ELSE 0 END, CASE suffix WHEN 'xlsx' THEN 0 WHEN 'xls' THEN 1 ELSE 3 END, path LIMIT 1""")
def dictionary_file(spark, sf):
    """Of names that hint at a dictionary the first, by folder, kind of file and name."""
    k = F.col("p_partkey")
    stem = F.when(k % 5 == 0, "Columns").when(k % 5 == 1, "mapping").when(k % 5 == 2, "~$dict").otherwise("part")
    suffix = F.when(k % 4 == 0, "csv").when(k % 4 == 1, "xls").when(k % 4 == 2, "txt").otherwise("xlsx")
    path = F.concat(F.lit("/d"), (F.col("p_size") % 3).cast("string"), F.lit("/"), stem, k.cast("string"), F.lit("."), suffix)
    return fl.find_dictionary(fl.describe_paths(table(spark, sf, "part").select(path.alias("path"))), ("/d2", "/d1"))


@query("file_limit", """
  SELECT skip_reason, count(*) AS files FROM (SELECT CASE WHEN k % 7 = 0 THEN 'previous output' WHEN k % 7 = 2 THEN 'same data'
    WHEN k > last THEN 'beyond the limit' END AS skip_reason FROM (SELECT p_partkey AS k FROM part),
    (SELECT max(k) AS last FROM (SELECT p_partkey AS k FROM part WHERE p_partkey % 7 NOT IN (0, 2) ORDER BY 1 LIMIT 25))) GROUP BY 1""")
def file_limit(spark, sf):
    """The first files in order, of those that may be read."""
    marked = fl.eligible(part_files(spark, sf), None, "_cleaned", limit=25)
    reason = F.when(F.col("skip_reason").startswith("same data"), "same data").otherwise(F.col("skip_reason"))
    return marked.groupBy(reason.alias("skip_reason")).agg(F.count(F.lit(1)).alias("files"))


# --- reading ------------------------------------------------------------------------------ #
@query("ingest_empty_columns", f"""
  SELECT {UNIT_SQL} AS entity, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_rows, 3 AS n_cols, 1 AS n_numeric, 1 AS n_text,
    'dropped 1 empty column(s)' AS notes FROM events GROUP BY 1, 2""")
def ingest_empty_columns(spark, sf):
    """Rows and columns without a cell are left out; the column is counted."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    lines = unit_files(spark, sf, [], (stamp, F.col("value").cast("string"), F.col("metric"), F.lit("")))
    lines = lines.withColumn("raw", F.when(F.col("raw") == "time,power,status", "time,power,status,spare").otherwise(F.col("raw")))
    blank = lines.where("seq % 3 = 0 AND seq > 1000").withColumn("raw", F.lit(" , ,\t,"))
    out = ing.ingest(spark, stored(lines.unionByName(blank))).files
    day = F.element_at(F.split("file", "/"), -2)
    return out.select("entity", day.alias("day"), "n_rows", "n_cols", "n_numeric", "n_text", F.array_join("notes", "; ").alias("notes"))


@query("ingest_poor_time", f"""
  WITH e AS (SELECT {UNIT_SQL} AS entity, strftime(ts, '%Y-%m-%d') AS day, event_id * 7919 % 10 >= user_id % 10 AS good FROM events),
  f AS (SELECT entity, day, count(*) AS n, count(*) FILTER (good) AS n_good FROM e GROUP BY 1, 2)
  SELECT entity, day, CASE WHEN 2 * n_good >= n THEN n_good ELSE n END AS n_rows, CASE WHEN 2 * n_good >= n THEN 'time' ELSE '(none)' END AS time_column FROM f""")
def ingest_poor_time(spark, sf):
    """Times that cannot be read: a few rows go, many make the column text."""
    good = (F.col("row_no") * 7919) % 10 >= F.substr("entity", F.lit(3)).cast("int")
    # what looks like a time but is none
    stamp = F.when(good, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise("2024-99-99 00:00:00")
    lines = unit_files(spark, sf, [], (stamp, F.col("value").cast("string"), F.col("metric")))
    out = ing.ingest(spark, lines).files
    return out.select("entity", F.element_at(F.split("file", "/"), -2).alias("day"), "n_rows", F.coalesce("time_column", F.lit("(none)")).alias("time_column"))


@query("ingest_header_row", UNIT_FILE_SQL.format(status="event_type"))
def ingest_header_row(spark, sf):
    """A header whose row is given, above rows that look like data."""
    lines = unit_files(spark, sf, ["1,2,3", "4,5,6"], (F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col("value").cast("string"), F.col("metric")))
    return with_event(ing.ingest(spark, lines, ReaderParams(header_row=2)).readings)


@query("header_names", """
  WITH h AS (SELECT p_type AS file, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS idx,
      CASE WHEN p_size % 3 > 0 THEN p_brand END AS head FROM part),
  f AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY file ORDER BY idx), 'col' || idx) AS text FROM h),
  n AS (SELECT *, row_number() OVER (PARTITION BY file, text ORDER BY idx) - 1 AS nth FROM f)
  SELECT file, idx, text || CASE WHEN nth > 0 THEN '#' || nth ELSE '' END AS raw FROM n""")
def header_names(spark, sf):
    """Blank header cells take the name to their left, repeats are numbered."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("p_type").orderBy("p_partkey")) - 1
    none = F.lit(None).cast("array<string>")
    head = table(spark, sf, "part").select(F.col("p_type").alias("file"), place.alias("idx"), F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).alias("head"), none.alias("extra"))
    return ing.column_names(head).select("file", F.col("idx").cast("long").alias("idx"), "raw")


# --- writing -------------------------------------------------------------------------------- #
@query("cleaned_by_unit", f"""
  SELECT r.entity, c.name, count(*) AS rows, round(sum(r.value), 3) AS total, 'units' AS part FROM ({RD}) r JOIN ({CHANNELS_SQL}) c ON c.metric = r.metric
  WHERE c.include GROUP BY 1, 2
  UNION ALL SELECT 'PLANT', 'ch view', count(*), round(sum(value), 3), 'plant' FROM (SELECT time_bucket(INTERVAL '1 day', ts) AS ts, round(avg(value), 3) AS value
    FROM events WHERE event_type = 'view' GROUP BY 1)
  UNION ALL SELECT {UNIT_SQL}, 'alarm', count(*), round(sum(value), 3), 'status_alarms' FROM events WHERE event_type = 'error' GROUP BY 1""")
def cleaned_by_unit(spark, sf):
    """Units, the plant and its status bits, each written and read again."""
    path = new_folder(spark)
    site = fleet_channels(spark, sf, "1 day").where("metric = 'view'").select(
        F.lit("events").alias("file"), F.lit(PLANT).alias("entity"), "metric", "ts", "value", F.lit(0).cast("long").alias("row_no"))
    rows = readings(spark, sf).unionByName(site).withColumn("day", F.to_date("ts")).withColumn("text", F.lit(None).cast("string"))
    alarms = raw_events(spark, sf).where("metric = 'error'").select("entity", F.lit("alarm").alias("name"), "value")
    sinks.write_by_entity(rows, channels(spark, sf), alarms, path)
    parts = [spark.read.parquet(f"{path}/{p}").select("entity", "name", "value", F.lit(p).alias("part")) for p in ("units", "plant", "status_alarms")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("entity", "name", "part").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 3).alias("total"))


@query("summary_csv", f"""
  SELECT entity, metric, count(*)::VARCHAR AS samples, CASE WHEN min(value) < 3 THEN NULL ELSE round(min(value), 2)::VARCHAR END AS least FROM ({EV_SQL}) GROUP BY 1, 2""")
def summary_csv(spark, sf):
    """A summary as CSV, read as text: a header, null as nothing."""
    path = new_folder(spark)
    least = F.round(F.min("value"), 2)
    summary = raw_events(spark, sf).groupBy("entity", "metric").agg(F.count(F.lit(1)).alias("samples"), F.when(least < 3, None).otherwise(least).alias("least"))
    sinks.write_tables({"summary": summary}, path, "csv")
    return spark.read.option("header", True).csv(f"{path}/summary").select("entity", "metric", "samples", "least")


@query("run_information", """
  SELECT * FROM (SELECT 0 AS pos, 'rows' AS key, count(*)::VARCHAR AS value FROM events UNION ALL SELECT 1, 'units', count(DISTINCT user_id % 10)::VARCHAR FROM events
    UNION ALL SELECT 2, 'note', '' UNION ALL SELECT 2 + row_number() OVER (ORDER BY event_type), 'message', event_type || ' seen' FROM (SELECT DISTINCT event_type FROM events))""")
def run_information(spark, sf):
    ev = raw_events(spark, sf)
    told = ev.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("entity").alias("units"), F.array_sort(F.collect_set("metric")).alias("kinds")).first()
    return sinks.run_info(spark, {"rows": told["rows"], "units": told["units"], "note": None}, [f"{k} seen" for k in told["kinds"]])


# --- limits, scopes ---------------------------------------------------------------------------- #
@query("flags_capped", """
  SELECT file, least(count(*), 40) AS flags FROM (SELECT user_id % 10 AS file, value FROM events WHERE value < 5 OR value > 95) GROUP BY 1""")
def flags_capped(spark, sf):
    """Flags up to a cap for each file, the only place where one is asked for."""
    ev = raw_events(spark, sf).withColumn("file", F.expr("cast(substring(entity, 2) AS int)"))
    found = rules.collect_flags(ev, None, [Rule("threshold", value=5.0, operator="<"), Rule("threshold", value=95.0, operator=">")], cap=40)
    return found.groupBy(F.col("file").cast("long").alias("file")).agg(F.count(F.lit(1)).alias("flags"))


@query("tidy_capped", "SELECT least(count(*), 700) AS rows FROM events")
def tidy_capped(spark, sf):
    return tidy(raw_events(spark, sf), limit=700).groupBy().agg(F.count(F.lit(1)).alias("rows"))


@query("rule_scope_names", """
  SELECT p_partkey, regexp_matches(p_name, '1[1-3]') OR regexp_matches(p_brand, '1[1-3]') AS by_pattern, p_brand IN ('Brand#1', 'Brand#13') OR p_type = 'ECONOMY' AS by_list, p_size % 2 = 0 AS numeric FROM part""")
def rule_scope_names(spark, sf):
    """Channels that go by two names: a rule applies if it names either."""
    numeric = F.col("p_size") % 2 == 0
    rule = {"by_pattern": (Rule("zero", scope="pattern", pattern="1[1-3]"), ("p_name", "p_brand")),
            "by_list": (Rule("zero", scope="selected", columns=("Brand#1", "Brand#13", "ECONOMY")), ("p_brand", "p_type")), "numeric": (Rule("zero", scope="numeric"), ("p_name",))}
    return table(spark, sf, "part").select("p_partkey", *[rules.in_scope(r, names, numeric).alias(n) for n, (r, names) in rule.items()])


# --- answers that depend on rows ------------------------------------------------------------------ #
@query("roles_of_sites", """
  WITH k AS (SELECT user_id % 10 AS site, event_type, row_number() OVER (PARTITION BY user_id % 10 ORDER BY count(*) DESC, event_type) AS place FROM events GROUP BY 1, 2)
  SELECT site::BIGINT AS site, CASE place WHEN 1 THEN 'ac_power' WHEN 2 THEN 'dc_power' WHEN 3 THEN 'irradiance' WHEN 4 THEN 'ac_energy' WHEN 5 THEN 'temp' END AS role,
    event_type AS metric FROM k WHERE place <= 5""")
def roles_of_sites(spark, sf):
    """Every site names its channels by how often they report; roles follow the names."""
    from pyspark.sql import Window

    counts = raw_events(spark, sf).groupBy("entity", "metric").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("n"), "metric"))
    names = F.array(*[F.lit(n) for n in ("①交流電力", "直流電力 合計", "日射量(傾斜)", "交流電力量", "外気温")])
    found = counts.withColumn("pos", place).select(
        F.expr("cast(substring(entity, 2) AS bigint)").alias("site"), "metric", "pos", F.get(names, F.col("pos") - 1).alias("name"),
        F.col("metric").alias("raw"), F.lit(True).alias("is_numeric"))
    return diagnostics.guess_roles(found, keys=["site"])


@query("shared_sensors", f"""
  WITH n AS (SELECT event_type AS metric, count(*) % 2 = 0 AS shared FROM events GROUP BY 1)
  SELECT metric, shared FROM n""")
def shared_sensors(spark, sf):
    """Channels of an even number of events are given to all units alike, others keep their own values."""
    ev = raw_events(spark, sf)
    even = ev.groupBy("metric").agg((F.count(F.lit(1)) % 2 == 0).alias("even"))
    one = fleet_channels(spark, sf, "1 day").select("metric", "ts", F.col("value").alias("same"))
    day = readings(spark, sf)
    units = day.select("metric", "entity").distinct()
    grid = units.join(one, "metric").join(even, "metric").join(day.select("metric", "entity", "ts", "value"), ["metric", "entity", "ts"], "left")
    own = grid.select("metric", "ts", "entity", F.when(F.col("even"), F.col("same")).otherwise(F.col("value")).alias("value"))
    return align.shared_channels(own)


@query("quality_of_files", f"""
  SELECT file, count(*) AS rows, CASE WHEN day(file::DATE) % 2 = 0 THEN 'cp932' ELSE 'utf-8-sig' END AS encoding,
    CASE WHEN count(DISTINCT metric) % 2 = 0 THEN 'TAB' ELSE ';' END AS delimiter, day(file::DATE) + 1 AS header_row,
    count(DISTINCT entity) || ' units; ' || count(DISTINCT metric) || ' channels' AS notes FROM ({DF}) GROUP BY file""")
def quality_of_files(spark, sf):
    """How every file was read goes into its report."""
    rows = day_files(spark, sf)
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("metric").alias("n_numeric"), F.countDistinct("entity").alias("n_units"))
    day = F.dayofmonth(F.to_date("file"))
    files = files.select(
        "file", F.lit("U").alias("entity"), F.to_date("file").alias("day"), "n_rows", F.lit(6).alias("n_cols"), "n_numeric", F.lit(0).alias("n_text"),
        F.lit("ts").alias("time_column"), F.when(day % 2 == 0, "cp932").otherwise("utf-8-sig").alias("encoding"),
        F.when(F.col("n_numeric") % 2 == 0, "\t").otherwise(";").alias("delimiter"), day.alias("header_row"),
        F.array(F.concat(F.col("n_units").cast("string"), F.lit(" units")), F.concat(F.col("n_numeric").cast("string"), F.lit(" channels"))).alias("notes"))
    out = summaries.quality_report(rows.withColumn("row_no", F.xxhash64("entity", "metric")), files)
    return out.select("file", "rows", "encoding", "delimiter", "header_row", "notes")
