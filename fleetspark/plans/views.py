"""The given tables seen as telemetry.

Ten units from the users of ``events``, one channel per event type; the oracle
builds the same views from the SQL beside each function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspark.functions.timefn import bucket
from fleetspark.operators.align import resample
from fleetspark.session import pin_time_zone

ENTITIES = [f"U{i:02d}" for i in range(10)]
METRICS = ["click", "error", "purchase", "signup", "view"]
ROLES = {"ac_power": "purchase", "dc_power": "click", "irradiance": "view", "temp": "error"}

UNIT_SQL = "'U' || lpad((user_id % 10)::VARCHAR, 2, '0')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_time_zone(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shown(df: DataFrame) -> DataFrame:
    """Dates and times as text, so that results compare alike everywhere."""
    forms = {T.DateType: "yyyy-MM-dd", T.TimestampType: "yyyy-MM-dd HH:mm:ss", T.TimestampNTZType: "yyyy-MM-dd HH:mm:ss"}
    return df.select(*[
        F.date_format(f.name, forms[type(f.dataType)]).alias(f.name) if type(f.dataType) in forms else F.col(f.name)
        for f in df.schema.fields])


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event a reading: file, entity, metric, ts, value, row_no."""
    unit = F.concat(F.lit("U"), F.lpad((F.col("user_id") % 10).cast("string"), 2, "0"))
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("file"), unit.alias("entity"), F.col("event_type").alias("metric"),
        "ts", "value", F.col("event_id").alias("row_no"))


EV_SQL = (f"SELECT 'events' AS file, {UNIT_SQL} AS entity, event_type AS metric, ts, value, event_id AS row_no "
          "FROM events")


def readings(spark: SparkSession, sf_dir: str, width: str = "1 day") -> DataFrame:
    """Mean per unit, channel and time bin."""
    binned = resample(raw_events(spark, sf_dir).drop("row_no"), width)
    return binned.select("file", "entity", "metric", "ts", F.round("value", 3).alias("value"),
                         F.lit(0).cast("long").alias("row_no"))


def readings_sql(width: str = "1 day") -> str:
    return (f"SELECT 'events' AS file, {UNIT_SQL} AS entity, event_type AS metric, "
            f"time_bucket(INTERVAL '{width}', ts) AS ts, round(avg(value), 3) AS value, 0 AS row_no "
            "FROM events GROUP BY 2, 3, 4")


def day_files(spark: SparkSession, sf_dir: str, width: str = "6 hours") -> DataFrame:
    """The same with one file per day."""
    return readings(spark, sf_dir, width).withColumn("file", F.date_format("ts", "yyyy-MM-dd"))


def day_files_sql(width: str = "6 hours") -> str:
    return (f"SELECT strftime(ts, '%Y-%m-%d') AS file, entity, metric, ts, value, row_no "
            f"FROM ({readings_sql(width)})")


def fleet_channels(spark: SparkSession, sf_dir: str, width: str = "6 hours") -> DataFrame:
    """Mean per channel over all units: one value per bin and event type."""
    ev = raw_events(spark, sf_dir).groupBy("metric", bucket("ts", width).alias("ts")).agg(
        F.round(F.avg("value"), 3).alias("value"))
    return ev.select(F.lit("FLEET").alias("entity"), "metric", "ts", "value")


def fleet_channels_sql(width: str = "6 hours") -> str:
    return (f"SELECT event_type AS metric, time_bucket(INTERVAL '{width}', ts) AS ts, round(avg(value), 3) AS value "
            "FROM events GROUP BY 1, 2")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per day: U00_click ... U09_view, a site column and status bits ANN_<unit><no>; units and channels are
    those of the table."""
    day = readings(spark, sf_dir)
    found = day.groupBy().agg(F.sort_array(F.collect_set("entity")), F.sort_array(F.collect_set("metric"))).first()
    entities, metrics = found[0], found[1]
    names = [f"{e}_{m}" for e in entities for m in metrics]
    cells = day.withColumn("raw", F.concat_ws("_", "entity", "metric")).groupBy("ts").pivot("raw", names).agg(
        F.first("value"))
    bits = [F.when(F.coalesce(F.col(f"{e}_{m}") > 52.0, F.lit(False)), 1.0).otherwise(0.0).alias(f"ANN_{e[1:]}{j:02d}")
            for e in entities for j, m in enumerate(metrics, 1)]
    site = fleet_channels(spark, sf_dir, "1 day").where("metric = 'error'").select(
        F.col("ts").alias("_ts"), F.col("value").alias("Site_temp"))
    rows = cells.join(site, F.col("ts") == F.col("_ts"), "left").drop("_ts")
    return rows.select("ts", *names, "Site_temp", *bits)


WIDE_CELLS_SQL = f"""
  SELECT d.ts, e.entity, m.metric, r.value
  FROM (SELECT DISTINCT ts FROM ({readings_sql()})) d
  CROSS JOIN (SELECT DISTINCT {UNIT_SQL} AS entity FROM events) e
  CROSS JOIN (SELECT DISTINCT event_type AS metric FROM events) m
  LEFT JOIN ({readings_sql()}) r ON r.ts = d.ts AND r.entity = e.entity AND r.metric = m.metric
"""


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A description of the channels, one row per event type found."""
    found = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(
        F.min("event_id").alias("pos"))
    return found.select(
        "metric", "pos", F.col("metric").alias("raw"),
        F.concat(F.lit("ch "), F.col("metric")).alias("name"),
        F.when(F.col("metric") == "error", "C").when(F.col("metric") == "signup", "kWh").otherwise("kW").alias("unit"),
        F.lit("").alias("note"),
        F.when(F.col("metric") == "signup", "1 min diff").otherwise("instant").alias("kind"),
        (F.col("metric") == "view").alias("shared"), F.lit(True).alias("is_numeric"),
        (F.col("metric") != "error").alias("include"), F.lit(None).cast("int").alias("decimals"),
        F.lit(True).alias("matched"))


CHANNELS_SQL = """
  SELECT event_type AS metric, min(event_id) AS pos, event_type AS raw, 'ch ' || event_type AS name,
         CASE event_type WHEN 'error' THEN 'C' WHEN 'signup' THEN 'kWh' ELSE 'kW' END AS unit,
         CASE event_type WHEN 'signup' THEN '1 min diff' ELSE 'instant' END AS kind,
         event_type = 'view' AS shared, event_type <> 'error' AS include
  FROM events GROUP BY event_type
"""
