"""Summaries per day, per channel, per file and per status bit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions.timefn import DAY_US, HOUR_US, micros
from fleetspark.operators.align import row_interval
from fleetspark.operators.ordered import DEFAULT_CHUNK, with_position, with_previous, with_runs
from fleetspark.params import DELTA_MARKERS


def is_delta(kind: Column) -> Column:
    """True where a channel's kind says its readings are amounts per interval."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    test = F.lit(False)
    for marker in DELTA_MARKERS:
        test = test | low.contains(marker)
    return test


def daily_summary(readings: DataFrame, channels: DataFrame | None = None, round_to: int = 3,
                  chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Per file, unit, date and channel: samples, coverage, mean, extremes, total, zeros.

    ``total`` sums difference channels and integrates the others over the file's
    interval. Only the aggregate is joined, never the readings.
    """
    v = F.col("value")
    days = readings.groupBy("file", "entity", F.to_date("ts").alias("date"), "metric").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("value").alias("samples"),
        F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"),
        F.sum("value").alias("_sum"),
        F.count_if(v == 0).alias("zero_samples"),
        F.count_if(v.isNull()).alias("missing"),
        F.count_if(v < 0).alias("negative"),
    )
    days = days.join(row_interval(readings, chunk=chunk), ["file", "entity"], "left")
    if channels is not None:
        days = days.join(
            channels.select("metric", "name", "unit", is_delta(F.col("kind")).alias("_delta")), "metric", "left")
    else:
        days = days.withColumn("name", F.col("metric")).withColumn("unit", F.lit("")).withColumn("_delta", F.lit(False))
    delta = F.coalesce("_delta", F.lit(False))
    expected = F.when(F.col("interval_us") > 0, F.bround(F.lit(float(DAY_US)) / F.col("interval_us")).cast("long")
                      ).otherwise(F.col("rows"))
    hours = F.col("interval_us") / F.lit(float(HOUR_US))
    total = F.when(delta, F.col("_sum")).otherwise(F.col("_sum") * hours)
    return (
        days.withColumn("expected", expected)
        .select(
            "file", "entity", "date", "metric",
            F.coalesce(F.nullif("name", F.lit("")), "metric").alias("name"),
            F.coalesce("unit", F.lit("")).alias("unit"),
            "samples", "expected",
            F.round(F.try_divide(F.col("samples") * 100.0, F.col("expected")), 2).alias("coverage_pct"),
            *[F.round(c, round_to).alias(c) for c in ("mean", "max", "min")],
            F.round(total, round_to).alias("total"),
            F.when(delta, "sum of differences").otherwise("value x interval").alias("total_note"),
            "zero_samples",
            F.round(F.try_divide(F.col("zero_samples") * 100.0, F.col("samples")), 2).alias("zero_pct"),
            "missing", "negative",
        )
    )


def zero_report(readings: DataFrame, order: Sequence[str] = ("ts", "row_no"),
                keys: Sequence[str] = ("file", "entity", "metric"),
                chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Channels with zeros: how many, which share of the valid, the longest run."""
    zero = F.coalesce(F.col("value") == 0, F.lit(False))
    flagged = readings.select(*keys, *order, "value", zero.alias("_zero"))
    return (
        with_runs(flagged, keys, order, "_zero", chunk)
        .groupBy(*keys).agg(
            F.count("value").alias("valid"),
            F.count_if("_zero").alias("zero_samples"),
            F.max(F.when(F.col("_zero"), F.col("run_len"))).alias("longest_zero_run"))
        .where(F.col("zero_samples") > 0)
        .withColumn("zero_pct", F.round(F.col("zero_samples") * 100.0 / F.col("valid"), 2))
    )


def zero_order(rows: DataFrame) -> DataFrame:
    """Adds ``rank``: the largest share of zeros first, then by unit."""
    return with_position(rows, [F.desc("zero_pct"), "entity", *[c for c in ("file", "metric") if c in rows.columns]], "rank")


def time_gaps(readings: DataFrame, keys: Sequence[str] = ("file", "entity"),
              factor: float = 1.5, chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Per file: rows, interval and how often a step exceeds 1.5 intervals."""
    order = ["ts", "row_no"] if "row_no" in readings.columns else ["ts"]
    rows = readings.select(*keys, *order).distinct()
    steps = with_previous(rows, keys, order, ["ts"], "_prev", chunk)
    step = micros("ts") - micros("_prev.ts")
    # steps of equal length are counted together before they meet their interval
    sizes = steps.groupBy(*keys, step.alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
    modal = F.min_by("_step", F.when(F.col("_step").isNotNull(), F.struct(-F.col("_n"), F.col("_step"))))
    found = (
        sizes.groupBy(*keys).agg(F.sum("_n").alias("rows"), modal.alias("_modal"))
        .select(*keys, "rows", F.when(F.col("rows") >= 3, F.col("_modal")).alias("interval_us")))
    late = F.col("_step") > F.col("interval_us") * factor
    return (
        sizes.join(found, [*keys]).groupBy(*keys, "rows", "interval_us")
        .agg(F.coalesce(F.sum(F.when(late, F.col("_n"))), F.lit(0).cast("long")).alias("gaps"))
    )


def quality_report(readings: DataFrame, files: DataFrame, chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Per file: rows, columns, interval, gaps and how it was read."""
    gaps = time_gaps(readings, ["file"], chunk=chunk)
    return (
        files.join(gaps.withColumnRenamed("rows", "_rows"), "file", "left")
        .select(
            "file", "entity", "day",
            F.coalesce("_rows", "n_rows").alias("rows"),
            "n_cols", "n_numeric", "n_text",
            F.coalesce("time_column", F.lit("(none)")).alias("time_column"),
            "interval_us", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"),
            "encoding",
            F.when(F.col("delimiter") == "\t", "TAB").otherwise(F.col("delimiter")).alias("delimiter"),
            (F.col("header_row") + 1).alias("header_row"),
            F.array_join("notes", "; ").alias("notes"),
        )
    )


def alarm_order(rows: DataFrame) -> DataFrame:
    """Adds ``rank``: by unit, what was on longest first."""
    return with_position(rows, ["entity", F.desc("minutes_on"), *[c for c in ("bit", "file") if c in rows.columns]], "rank")


def alarm_summary(bits: DataFrame, channels: DataFrame | None = None,
                  keys: Sequence[str] = ("file", "entity", "bit"),
                  order: Sequence[str] = ("ts", "row_no"), active_only: bool = True,
                  chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Per status bit: rows on, share of all rows, separate on-periods, first and last time.

    ``bits`` has ``keys``, ``order`` and ``value``.
    """
    on = F.coalesce(F.col("value") > 0, F.lit(False))
    rows = bits.select(*keys, *order, on.alias("_on"))
    edges = with_previous(rows, keys, order, ["_on"], "_prev", chunk)
    starts = F.col("_on") & ~F.coalesce("_prev._on", F.lit(False))
    out = edges.groupBy(*keys).agg(
        F.count_if("_on").alias("minutes_on"),
        F.round(F.count_if("_on") * 100.0 / F.count(F.lit(1)), 2).alias("share_pct"),
        F.count_if(starts).alias("events"),
        F.min(F.when(F.col("_on"), F.col("ts"))).alias("first_on"),
        F.max(F.when(F.col("_on"), F.col("ts"))).alias("last_on"),
    )
    if channels is not None:
        named = channels.where("matched").select(F.col("metric").alias("bit"), "name")
        out = out.join(named, "bit", "left").fillna("", ["name"])
    return out.where(F.col("minutes_on") > 0) if active_only else out


def daily_pivot(daily: DataFrame, entities: Sequence[str], value: str = "mean") -> DataFrame:
    """Date x unit table of a daily-summary column."""
    return daily.groupBy("metric", "date").pivot("entity", list(entities)).agg(F.avg(value))


def unit_ranking(daily: DataFrame, value: str = "total", limit_pct: float = 3.0) -> DataFrame:
    """Total per metric and unit against the fleet mean, worst first."""
    totals = daily.groupBy("metric", "entity").agg(F.sum(value).alias("total"))
    totals = totals.where(F.col("total").isNotNull())
    fleet = Window.partitionBy("metric")
    mean = F.avg("total").over(fleet)
    pct = (F.col("total") - F.col("fleet_mean")) / (F.abs("fleet_mean") + 1e-9) * 100.0
    return (
        totals.withColumn("fleet_mean", mean)
        .withColumn("vs_mean_pct", pct)
        .withColumn("class", F.when(F.col("vs_mean_pct") < -limit_pct, "below")
                    .when(F.col("vs_mean_pct") > limit_pct, "above").otherwise("near"))
        .withColumn("rank", F.row_number().over(fleet.orderBy("total", "entity")))
    )
