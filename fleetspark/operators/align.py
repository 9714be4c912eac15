"""Time alignment of units and their deviation from the fleet.

Input is the long ``readings`` table: file, entity, ts, metric, value, row_no.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions.timefn import bucket, duration_us, micros, snap
from fleetspark.operators.ordered import DEFAULT_CHUNK, with_previous


def resample(readings: DataFrame, width: str, channels: DataFrame | None = None,
             delta_agg: str = "mean") -> DataFrame:
    """Left-closed time bins: mean of the numbers, first text, empty bins dropped.

    ``delta_agg="sum"`` adds up channels whose kind says they are differences
    (``channels`` has metric and is_delta) instead of averaging them.
    """
    keys = [c for c in ("file", "entity", "day") if c in readings.columns]
    order = F.struct("ts", *[c for c in ("row_no",) if c in readings.columns])
    aggs = [F.avg("value").alias("_mean"), F.sum("value").alias("_sum")]
    if "text" in readings.columns:
        aggs.append(F.min_by("text", F.when(F.col("text").isNotNull(), order)).alias("text"))
    binned = readings.groupBy(*keys, "metric", bucket("ts", width).alias("ts")).agg(*aggs)
    value = F.col("_mean")
    if delta_agg == "sum" and channels is not None:
        binned = binned.join(channels.select("metric", "is_delta"), "metric", "left")
        value = F.when(F.coalesce("is_delta", F.lit(False)), F.col("_sum")).otherwise(value)
    kept = F.col("value").isNotNull()
    if "text" in readings.columns:
        kept = kept | F.col("text").isNotNull()
    return binned.withColumn("value", value).where(kept).drop("_mean", "_sum", "is_delta")


def first_per_instant(readings: DataFrame, keys: Sequence[str] = ("entity", "metric")) -> DataFrame:
    """One value per series and timestamp: the first by file and row."""
    order = F.struct(*[c for c in ("file", "row_no") if c in readings.columns] or ["value"])
    return readings.groupBy(*keys, "ts").agg(F.min_by("value", order).alias("value"))


def modal_interval(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts",),
                   chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Most frequent step between neighbouring rows (``interval_us``, smallest on ties).

    Series with fewer than three rows have no interval and no result row.
    """
    steps = with_previous(rows.select(*keys, *order), keys, order, ["ts"], "_prev", chunk)
    diff = micros("ts") - micros("_prev.ts")
    return (
        steps.where(F.col("_prev").isNotNull())
        .groupBy(*keys, diff.alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*keys)
        .agg(F.min_by("_step", F.struct(-F.col("_n"), F.col("_step"))).alias("interval_us"),
             F.sum("_n").alias("_steps"))
        .where(F.col("_steps") >= 2)
        .drop("_steps")
    )


def row_interval(readings: DataFrame, keys: Sequence[str] = ("file", "entity"),
                 chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Modal interval of the rows of a file, whatever their channels."""
    order = ["ts", "row_no"] if "row_no" in readings.columns else ["ts"]
    rows = readings.select(*keys, *order).distinct()
    return modal_interval(rows, keys, order, chunk)


def aligned(readings: DataFrame, grid: str | None = None, tolerance: str = "30 seconds",
            round_to: int | None = 3, chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Units on one time grid per metric: metric, ts, entity, value.

    The grid is the smallest of the series' modal intervals. Two readings that
    snap to the same instant leave the earlier one.
    """
    if grid is None:
        unique = first_per_instant(readings)
        steps = modal_interval(unique, ["entity", "metric"], ["ts"], chunk)
        grids = steps.groupBy("metric").agg(F.min("interval_us").alias("_grid"))
        readings = readings.join(grids, "metric", "left")
        fallback = F.lit(duration_us(tolerance))
        step = F.when(F.col("_grid") > 0, F.col("_grid")).otherwise(fallback)
    else:
        step = F.lit(duration_us(grid))
    order = F.struct("ts", *[c for c in ("file", "row_no") if c in readings.columns])
    out = readings.groupBy("metric", snap("ts", step).alias("_at"), "entity").agg(
        F.min_by("value", order).alias("value"))
    value = F.col("value") if round_to is None else F.round("value", round_to)
    return out.select("metric", F.col("_at").alias("ts"), "entity", value.alias("value"))


def metric_scale(values: DataFrame) -> DataFrame:
    """Per metric: units with data, largest absolute value, unit with the highest total."""
    totals = values.groupBy("metric", "entity").agg(
        F.sum("value").alias("_total"), F.max(F.abs("value")).alias("_peak"))
    return totals.where(F.col("_peak").isNotNull()).groupBy("metric").agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.max("_peak").alias("scale"),
        F.min_by("entity", F.struct(-F.col("_total"), F.col("entity"))).alias("best"),
    )


def with_reference(values: DataFrame, mode: str = "mean") -> DataFrame:
    """Adds ``ref``, the fleet's mean, median, max or best unit at each instant.

    The window holds one row per unit.
    """
    fleet = Window.partitionBy("metric", "ts")
    if mode == "best":
        best = metric_scale(values).select("metric", "best")
        values = values.join(best, "metric", "left")
        ref = F.max(F.when(F.col("entity") == F.col("best"), F.col("value"))).over(fleet)
        return values.withColumn("ref", ref).drop("best")
    how = {"mean": F.avg, "median": F.median, "max": F.max}[mode]
    return values.withColumn("ref", how("value").over(fleet))


def deviation(values: DataFrame, mode: str = "mean", percent: bool = True,
              floor_pct: float = 2.0, floor_abs: float = 0.0, round_to: int = 3) -> DataFrame:
    """Adds ``ref`` and ``deviation`` to aligned values.

    Percent deviation is null where the reference is too close to zero to divide
    by. A metric with a single unit has neither.
    """
    scale = metric_scale(values).select("metric", "n_entities", "scale")
    out = with_reference(values, mode).join(scale, "metric", "left")
    several = F.col("n_entities") > 1
    gap = F.col("value") - F.col("ref")
    if percent:
        floor = F.greatest(F.lit(abs(floor_abs)), F.col("scale") * (max(0.0, floor_pct) / 100.0))
        dev = F.when(several & (F.abs("ref") > floor), gap / F.col("ref") * 100.0)
    else:
        dev = F.when(several, gap)
    return (
        out.withColumn("deviation", F.round(dev, round_to))
        .withColumn("ref", F.when(several, F.col("ref")))
        .drop("n_entities", "scale")
    )


def matrix(values: DataFrame, entities: Sequence[str], value: str = "value") -> DataFrame:
    """Time x unit table of aligned values; the units are given, in column order."""
    return values.groupBy("metric", "ts").pivot("entity", list(entities)).agg(F.first(value))


def common_metrics(channel_files: DataFrame, min_share: float = 0.6) -> DataFrame:
    """Numeric channels in at least ``max(1, int(share * files))`` files, first seen first.

    ``channel_files``: file, file_pos, pos, metric, is_numeric - one row per column.
    """
    n_files = channel_files.groupBy().agg(F.countDistinct("file").alias("n"))
    need = F.greatest(F.lit(1), F.floor(n_files.scalar() * F.lit(min_share)))
    return (
        channel_files.where("is_numeric").groupBy("metric")
        .agg(F.countDistinct("file").alias("files"),
             F.min(F.struct("file_pos", "pos")).alias("_first"))
        .where(F.col("files") >= need)
        .select("metric", "files", F.col("_first.file_pos").alias("file_pos"), F.col("_first.pos").alias("pos"))
    )


def _spread(readings: DataFrame, skip_all_zero: bool) -> DataFrame:
    per_file = readings.groupBy("file", "entity", "metric").agg(
        F.count("value").alias("_n"), F.avg("value").alias("_mean"),
        F.stddev_pop("value").alias("_std"), F.max(F.abs("value")).alias("_peak"))
    enough = F.col("_n") > 2
    if skip_all_zero:
        enough = enough & (F.col("_peak") > 0)
    cv = F.col("_std") / (F.abs("_mean") + 1e-9)
    return per_file.groupBy("metric").agg(
        F.coalesce(F.max(F.when(enough, cv)), F.lit(0.0)).alias("spread"))


def suggest_metrics(readings: DataFrame, channel_files: DataFrame, limit: int = 8,
                    min_share: float = 0.6) -> DataFrame:
    """The shared channels that vary most; all-constant data falls back to the first shared."""
    shared = common_metrics(channel_files, min_share)
    scored = shared.join(_spread(readings, True), "metric", "left").fillna(0.0, ["spread"])
    # one row per channel
    every = Window.partitionBy(F.lit(1))
    any_varies = F.max("spread").over(every) > 0
    by_spread = every.orderBy(F.desc("spread"), F.desc("metric"))
    by_place = every.orderBy("file_pos", "pos")
    rank = F.when(any_varies, F.row_number().over(by_spread)).otherwise(F.row_number().over(by_place))
    return (
        scored.withColumn("_varies", any_varies).withColumn("rank", rank)
        .where((F.col("rank") <= limit) & (~F.col("_varies") | (F.col("spread") > 0)))
        .select("rank", "metric", "spread")
    )


def suggest_wide_metrics(readings: DataFrame, channels: DataFrame, skip_shared: bool = True,
                         limit: int = 8) -> DataFrame:
    """As :func:`suggest_metrics` for unit channels: numeric, varying, not a shared sensor."""
    usable = channels.where(F.coalesce("is_numeric", F.lit(True)))
    if skip_shared:
        usable = usable.where(~F.coalesce("shared", F.lit(False)))
    ranked = F.row_number().over(
        Window.partitionBy(F.lit(1)).orderBy(F.desc("spread"), F.desc("metric")))
    return (
        _spread(readings, False).where("spread > 0")
        .join(usable.select("metric"), "metric", "left_semi")
        .withColumn("rank", ranked).where(F.col("rank") <= limit)
        .select("rank", "metric", "spread")
    )


def unit_stats(dev: DataFrame) -> DataFrame:
    """Mean deviation per metric and unit (of the value where a metric has none), 0 if empty."""
    per_unit = dev.groupBy("metric", "entity").agg(
        F.avg("deviation").alias("_dev"), F.avg("value").alias("_val"),
        F.count("deviation").alias("_n"))
    has = F.max("_n").over(Window.partitionBy("metric")) > 0
    stat = F.coalesce(F.when(has, F.col("_dev")).otherwise(F.col("_val")), F.lit(0.0))
    return per_unit.select("metric", "entity", stat.alias("stat"))


def entity_number(entity: str | Column) -> Column:
    """First number in a unit's name, null without one; the natural order of units."""
    entity = F.col(entity) if isinstance(entity, str) else entity
    return F.nullif(F.regexp_extract(entity, r"(\d+)", 1), F.lit("")).cast("decimal(38,0)")


def worst_units(dev: DataFrame, n: int = 6) -> DataFrame:
    """The ``n`` units per metric whose mean deviation is largest in size."""
    order = Window.partitionBy("metric").orderBy(
        F.desc(F.abs("stat")), entity_number("entity").asc_nulls_last(), "entity")
    return unit_stats(dev).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, n))


def row_spread(dev: DataFrame) -> DataFrame:
    """Spread of the values and largest absolute deviation per metric and instant."""
    aggs = [
        F.count("value").alias("n"),
        F.coalesce(F.max("value") - F.min("value"), F.lit(0.0)).alias("spread"),
        F.coalesce(F.bool_and(F.col("value") == 0), F.lit(False)).alias("all_zero"),
    ]
    if "deviation" in dev.columns:
        aggs.append(F.coalesce(F.max(F.abs("deviation")), F.lit(0.0)).alias("max_deviation"))
        aggs.append(F.count("deviation").alias("n_deviation"))
    return dev.groupBy("metric", "ts").agg(*aggs)


def filter_rows(dev: DataFrame, hide_zero: bool = False, min_spread: float = 0.0,
                view: str = "value") -> DataFrame:
    """Instants worth showing: with data, optionally not all zero, optionally spread enough."""
    rows = row_spread(dev)
    if view == "deviation":
        keep, size = F.col("n_deviation") > 0, F.col("max_deviation")
    else:
        keep, size = F.col("n") > 0, F.col("spread")
    if hide_zero:
        keep = keep & ~F.col("all_zero")
    if min_spread:
        keep = keep & (size >= min_spread)
    return rows.where(keep)


def fleet_mean(values: DataFrame) -> DataFrame:
    """Mean over the units per metric and instant."""
    return values.groupBy("metric", "ts").agg(F.avg("value").alias("mean"))


def day_counts(values: DataFrame) -> DataFrame:
    """Instants per metric and day."""
    return (
        values.select("metric", "ts").distinct()
        .groupBy("metric", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    )


def kpis(values: DataFrame, value: str = "value") -> DataFrame:
    """Per metric: samples, best and worst unit by mean, their distance, zeros."""
    units = values.groupBy("metric", "entity").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.count_if(F.col(value) == 0).alias("zeros"),
    ).where(F.col("n") > 0)
    # the first unit in natural order wins a tie
    place = F.struct(F.coalesce(entity_number("entity"), F.lit("9" * 38).cast("decimal(38,0)")), F.col("entity"))
    return units.groupBy("metric").agg(
        F.sum("n").alias("samples"),
        F.min_by("entity", F.struct(-F.col("mean"), place)).alias("best"),
        F.max("mean").alias("best_mean"),
        F.min_by("entity", F.struct(F.col("mean"), place)).alias("worst"),
        F.min("mean").alias("worst_mean"),
        (F.max("mean") - F.min("mean")).alias("spread"),
        F.sum("zeros").alias("zeros"),
    )


def shared_channels(values: DataFrame, plant: str = "PLANT") -> DataFrame:
    """Channels that carry one sensor: every unit equals the first unit at every instant."""
    units = values.groupBy("metric").agg(
        F.min("entity").alias("_first"), F.max("entity").alias("_last"))
    units = units.withColumn("_alone", F.col("_first") == F.col("_last"))
    per_metric = values.groupBy("metric", "entity").agg(F.count("value").alias("_k"))
    counts = per_metric.groupBy("metric").agg(
        F.count(F.lit(1)).alias("_units"), F.sum("_k").alias("_filled"))
    known = units.join(counts, "metric")
    fleet = Window.partitionBy("metric", "ts")
    first = F.max(F.when(F.col("entity") == F.col("_first"), F.col("value"))).over(fleet)
    filled = F.count("value").over(fleet)
    near = F.abs(F.col("_v0") - F.col("value")) <= 1e-9 + 1e-6 * F.abs("value")
    ok = F.when(F.col("_v0").isNull(), F.col("_filled_here") == 0).otherwise(
        (F.col("_filled_here") == F.col("_units")) & near)
    checked = (
        values.join(known, "metric")
        .withColumn("_v0", first).withColumn("_filled_here", filled)
        .groupBy("metric", "_first", "_alone", "_filled")
        .agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("_same"))
    )
    shared = F.when(F.col("_alone"), F.col("_first") == plant).otherwise(
        F.col("_same") & (F.col("_filled") > 0))
    return checked.select("metric", shared.alias("shared"))


__all__ = [
    "aligned", "common_metrics", "day_counts", "deviation", "entity_number",
    "filter_rows", "first_per_instant", "fleet_mean", "kpis", "matrix", "metric_scale",
    "modal_interval", "resample", "row_interval", "row_spread", "shared_channels",
    "suggest_metrics", "suggest_wide_metrics", "unit_stats", "with_reference", "worst_units",
]
