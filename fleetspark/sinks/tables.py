"""Writing results: cleaned readings, one table per analysis, CSV views, run information."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.operators.align import matrix
from fleetspark.operators.reshape import plant_readings, units_only
from fleetspark.operators.select import on_days, period_filter


def cleaned(readings: DataFrame, channels: DataFrame) -> DataFrame:
    """Readings of the included channels under their translated names, the raw name kept."""
    shown = channels.where(F.coalesce("include", F.lit(True))).select("metric", "name", "unit", "note", "decimals")
    # decimals is how to show a value; the value itself stays whole
    return readings.join(shown, "metric").select(
        "file", "entity", "day", "ts", F.col("metric").alias("raw"), "name", "unit", "note", "decimals", "value", "text", "row_no")


def write_cleaned(readings: DataFrame, channels: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per day. Rows are brought together by day and unit, so a day is several files, not one per task."""
    out = cleaned(readings, channels)
    out.repartitionByRange("day", "entity", "raw", "ts").write.mode(mode).partitionBy("day").parquet(path)


def write_by_date(readings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Readings in a folder per ``date``, that of their own time, so that a period is read from its days alone.

    Ranges of (date, unit, channel, time) go to a task each, so a day, a unit or a channel with many rows is several files.
    """
    rows = readings.withColumn("date", F.to_date("ts"))
    rows.repartitionByRange("date", "entity", "metric", "ts").write.mode(mode).partitionBy("date").parquet(path)


def read_by_date(spark: SparkSession, path: str, lo: str = "", hi: str = "") -> DataFrame:
    """What :func:`write_by_date` wrote, of a period; only folders of its days are opened. Rows without a time are in an open
    period only."""
    rows = spark.read.parquet(path)
    if lo:
        rows = rows.where(F.col("date") >= F.to_date(F.lit(lo[:10])))
    if hi:
        rows = rows.where(F.col("date") <= F.to_date(F.lit(hi[:10])))
    return period_filter(rows, lo, hi).drop("date")


def write_by_entity(readings: DataFrame, channels: DataFrame, alarms: DataFrame | None, path: str,
                    mode: str = "overwrite") -> None:
    """Units in a folder each, the plant's own channels and the status bits beside them."""
    out = cleaned(readings, channels)
    units_only(out).repartitionByRange("entity", "day", "raw", "ts").write.mode(mode).partitionBy("entity").parquet(f"{path}/units")
    plant_readings(out).write.mode(mode).parquet(f"{path}/plant")
    if alarms is not None:
        alarms.write.mode(mode).parquet(f"{path}/status_alarms")


def write_tables(tables: Mapping[str, DataFrame], path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    """A folder per table. CSV has a header and writes null as nothing."""
    for name, df in tables.items():
        writer = df.write.mode(mode)
        if form == "csv":
            writer.option("header", True).option("nullValue", "").option("emptyValue", "").csv(f"{path}/{name}")
        else:
            writer.format(form).save(f"{path}/{name}")


def view_csv(values: DataFrame, metric: str, entities: Sequence[str], value: str = "value",
             days: Sequence[str] = (), lo: str = "", hi: str = "") -> DataFrame:
    """The table behind a chart as it is shown: time and a column per unit, on the chosen days only."""
    rows = values.where((F.col("metric") == metric) & on_days(days, lo, hi))
    return matrix(rows, entities, value).drop("metric").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def run_info(spark: SparkSession, info: Mapping[str, object], messages: Sequence[str] = ()) -> DataFrame:
    """What a run was told and what it noticed: pos, key, value."""
    rows = [(k, "" if v is None else str(v)) for k, v in info.items()] + [("message", m) for m in messages]
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "pos int, key string, value string")


__all__ = ["cleaned", "run_info", "read_by_date", "view_csv", "write_by_date", "write_by_entity", "write_cleaned", "write_tables"]
