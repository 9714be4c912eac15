"""Datasets behind charts and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions.timefn import duration_us, micros
from fleetspark.operators.align import shared_channels
from fleetspark.operators.ordered import (
    DEFAULT_CHUNK,
    with_previous,
    with_row_number,
)
from fleetspark.params import ChartSpec

MAX_TABLE_CELLS = 400_000


def thin(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int | Column,
         chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Every ``ceil(n / limit)``-th row per key, from the first; adds ``step`` and ``rows_total``."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    count = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_total"))
    step = F.when((limit > 0) & (F.col("rows_total") > limit), F.ceil(F.col("rows_total") / limit)).otherwise(1)
    return (
        with_row_number(df, keys, order, "_pos", chunk).join(count, [*keys])
        .withColumn("step", step.cast("long"))
        .where(F.pmod(F.col("_pos") - 1, F.col("step")) == 0)
        .drop("_pos")
    )


def frame_payload(values: DataFrame, max_points: int = 4000, chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Aligned values thinned by instant, so that all units of a metric keep the same instants.

    The budget per series is ``max(200, min(max_points, 400000 / units))``.
    """
    instants = values.select("metric", "ts").distinct()
    units = values.select("metric", "entity").distinct().groupBy("metric").agg(F.count(F.lit(1)).alias("_units"))
    budget = F.greatest(F.lit(200), F.least(F.lit(max_points), F.floor(F.lit(MAX_TABLE_CELLS) / F.col("_units"))))
    kept = thin(instants.join(units, "metric"), ["metric"], ["ts"], budget, chunk).drop("_units")
    return values.join(kept, ["metric", "ts"]).withColumn("value", json_safe("value"))


def json_safe(value: str | Column, digits: int = 6) -> Column:
    """Null for what JSON cannot hold, otherwise rounded."""
    v = F.col(value) if isinstance(value, str) else value
    endless = F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(~endless, F.round(v, digits))


def metric_entries(values: DataFrame, channels: DataFrame | None = None, chosen: Sequence[str] = (),
                   with_deviation: bool = True) -> DataFrame:
    """One row per metric for the report: units, instants, cells, shared, chosen."""
    per_unit = values.groupBy("metric", "entity").agg(F.count(F.lit(1)).alias("_n"))
    units = per_unit.groupBy("metric").agg(
        F.array_sort(F.collect_list("entity")).alias("entities"), F.count(F.lit(1)).alias("_units"))
    instants = values.select("metric", "ts").distinct().groupBy("metric").agg(F.count(F.lit(1)).alias("rows_total"))
    out = (
        units.join(instants, "metric").join(shared_channels(values), "metric")
        .withColumn("cells", F.col("rows_total") * F.col("_units"))
        .withColumn("chosen", F.col("metric").isin(*chosen) if chosen else F.lit(True))
        .withColumn("has_deviation", F.lit(with_deviation) & (F.col("_units") > 1))
        .drop("_units")
    )
    if channels is not None:
        out = out.join(channels.select("metric", F.col("name").alias("title"), "unit"), "metric", "left")
    return out


def extra_channels(values: DataFrame, chosen: Sequence[str], max_points: int = 1500) -> DataFrame:
    """Channels outside the analysis: values only, with fewer points."""
    others = values.where(~F.col("metric").isin(*chosen)) if chosen else values
    return frame_payload(others.select("metric", "ts", "entity", "value"), max_points)


def table_head(table: DataFrame, order: Sequence[Column | str], limit: int = 5000) -> DataFrame:
    """The first rows with ``rows_total`` and ``truncated``."""
    total = table.groupBy().agg(F.count(F.lit(1)).alias("n")).scalar()
    head = table.orderBy(*order).limit(limit)
    return head.withColumn("rows_total", total).withColumn("truncated", F.col("rows_total") > limit)


def chart_series(readings: DataFrame, chart: ChartSpec, channels: DataFrame | None = None,
                 chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Points of a chart: file, entity, metric, label, unit, ts, x, y.

    X is time (``x`` holds microseconds) or another channel of the same row. A
    series needs two values; points without X or Y are left out.
    """
    keys = ["file", "entity", "metric"]
    order = [c for c in ("ts", "row_no") if c in readings.columns]
    rows = readings
    if chart.entities:
        rows = rows.where(F.col("entity").isin(*chart.entities))
    ys = [y for y in chart.y_columns if y != chart.x_column]
    y = rows.where(F.col("metric").isin(*ys)).select(*keys, *order, F.col("value").alias("y"))
    if chart.x_column:
        x = rows.where(F.col("metric") == chart.x_column).select(
            "file", "entity", *order, F.col("value").alias("x"))
        y = y.join(x, ["file", "entity", *order])
    else:
        y = y.withColumn("x", micros("ts").cast("double"))
    enough = y.groupBy(*keys).agg(F.count("y").alias("_n")).where(F.col("_n") >= 2).drop("_n")
    points = y.where(F.col("y").isNotNull() & F.col("x").isNotNull()).join(enough, keys, "left_semi")
    out = thin(points, keys, order, chart.max_points, chunk)
    if channels is not None:
        out = out.join(channels.select("metric", "name", "unit"), "metric", "left")
    else:
        out = out.withColumn("name", F.lit(None).cast("string")).withColumn("unit", F.lit(""))
    name = F.coalesce(F.nullif("name", F.lit("")), "metric")
    out = out.withColumn("unit", F.coalesce("unit", F.lit("")))
    if chart.normalize:
        out = pct_of_max(out, keys, "y")
    return out.withColumn("name", name).withColumn("label", F.concat_ws(" · ", F.nullif("entity", F.lit("")), "name"))


def group_series(series: DataFrame, chart: ChartSpec) -> DataFrame:
    """Adds ``chart`` (a series may be in several) and ``axis_unit``: one axis per unit of measure."""
    if chart.group_mode == "per_column":
        out = series.withColumn("chart", F.col("name"))
    elif chart.group_mode == "per_entity":
        out = series.withColumn("chart", F.coalesce(F.nullif("entity", F.lit("")), F.lit("all")))
    elif chart.group_mode == "pattern":
        names = F.array(F.lower("metric"), F.lower("name"))
        hits = [
            F.when(F.exists(names, lambda n: n.contains(p.strip().lower())), F.lit(p))  # noqa: B023
            for p in chart.patterns if p.strip()
        ]
        out = series.withColumn("chart", F.explode(F.array_compact(F.array(*hits)))) if hits else series.where("false")
    else:
        out = series.withColumn("chart", F.lit(chart.title or "chart"))
    return out.withColumn("axis_unit", F.lit("") if chart.normalize else F.col("unit"))


def pct_of_max(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """The value as percent of its series' largest size; a flat zero series is divided by 1."""
    top = df.groupBy(*keys).agg(F.max(F.abs(value)).alias("_top"))
    size = F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)
    return df.join(top, [*keys]).withColumn(value, F.col(value) / size * 100.0).drop("_top")


def amplify(df: DataFrame, keys: Sequence[str], gain: float, value: str = "value") -> DataFrame:
    """Swings around the series' own mean made ``gain`` (0.01 to 100) times larger."""
    g = max(0.01, min(100.0, float(gain))) if gain > 0 else 1.0
    mean = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    around = F.col("_mean") + g * (F.col(value) - F.col("_mean"))
    return df.join(mean, [*keys]).withColumn(value, around).drop("_mean")


def segments(instants: DataFrame, step: str, keys: Sequence[str] = ("metric",),
             chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Stretches of continuous time with their share of the axis.

    A step of more than 1.5 samples starts a new one. ``instants`` has ``keys`` and
    a unique ``ts``; days that are off must already be filtered out.
    """
    us = duration_us(step)
    gap = micros("ts") - micros("_prev.ts")
    # a step over midnight to a day that is not the next one is always longer than 1.5 samples
    stepped = with_previous(instants.select(*keys, "ts"), keys, ["ts"], ["ts"], "_prev", chunk)
    starts = F.col("_prev").isNull() | (gap > us * 1.5)
    marked = stepped.withColumn("_start", starts)
    # a stretch ends just before the next one starts, so its edges are found among the starts alone
    heads = marked.where("_start").select(*keys, F.col("ts").alias("t0"), F.col("_prev.ts").alias("_before"))
    ends = instants.groupBy(*keys).agg(F.max("ts").alias("_end"))
    order = Window.partitionBy(*keys).orderBy("t0")
    runs = (
        heads.join(ends, [*keys])
        .withColumn("t1", F.coalesce(F.lead("_before").over(order), F.col("_end")))
        .withColumn("segment", F.row_number().over(order))
    )
    width = F.greatest(F.lit(us), micros("t1") - micros("t0")).cast("double")
    total = F.sum("_width").over(Window.partitionBy(*keys))
    upto = F.sum("_width").over(order)
    return (
        runs.withColumn("_width", width)
        .withColumn("w1", upto / total)
        .withColumn("w0", (upto - F.col("_width")) / total)
        .select(*keys, "segment", "t0", "t1", "w0", "w1")
    )


def overlay(*frames: DataFrame) -> DataFrame:
    """Channels of different sampling rates on one time axis, matched by time and never by position."""
    out = frames[0].select("metric", "ts", "entity", "value")
    for f in frames[1:]:
        out = out.unionByName(f.select("metric", "ts", "entity", "value"))
    return out


__all__ = [
    "amplify", "chart_series", "extra_channels", "frame_payload", "group_series",
    "json_safe", "metric_entries", "overlay", "pct_of_max", "segments", "table_head", "thin",
]
