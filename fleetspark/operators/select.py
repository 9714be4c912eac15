"""Choosing channels, periods and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.functions.timefn import HOUR_US, from_micros, micros, ntz
from fleetspark.operators.ordered import with_position
from fleetspark.params import ColumnFilter


def filter_columns(channels: DataFrame, flt: ColumnFilter, protected: Column | None = None) -> DataFrame:
    """Sets ``include`` by what the name contains; exclusion beats inclusion.

    ``protected`` marks channels that are always kept (the time column, a file's first).
    """
    if not flt.enabled:
        return channels
    raw, name = F.coalesce("raw", F.lit("")), F.coalesce("name", F.lit(""))
    hay = [raw, name] if flt.use_raw_name else [F.when(name != "", name).otherwise(raw)]
    if not flt.case_sensitive:
        hay = [F.lower(h) for h in hay]

    def hit(needles):
        out = F.lit(False)
        for n in needles:
            n = n if flt.case_sensitive else n.lower()
            for h in hay if n else []:
                out = out | h.contains(n)
        return out

    keep = hit(flt.contains) if flt.contains else F.lit(True)
    if flt.exclude:
        keep = keep & ~hit(flt.exclude)
    if protected is not None:
        keep = protected | keep
    return channels.withColumn("include", keep)


def content_scope(channels: DataFrame, scope: str = "visible", selected: Sequence[str] = ()) -> DataFrame:
    """Numeric channels of an output in its order: the selected first, then the rest by ``pos``.

    ``scope`` is selected, visible or all; the result adds ``place`` (1, 2, ...).
    """
    wanted = F.lit(None).cast("int")
    for i, metric in enumerate(selected):
        wanted = F.when(F.col("metric") == metric, i).otherwise(wanted)
    rows = channels.where(F.coalesce("is_numeric", F.lit(True))).withColumn("_sel", wanted)
    if scope == "selected":
        rows = rows.where(F.col("_sel").isNotNull())
    elif scope == "visible":
        rows = rows.where(F.col("_sel").isNotNull() | F.coalesce("include", F.lit(True)))
    elif scope != "all":
        raise ValueError(f"unknown scope: {scope}")
    return with_position(rows, [F.col("_sel").asc_nulls_last(), F.col("pos"), F.col("metric")]).drop("_sel")


def cap_channels(scoped: DataFrame, most: int) -> DataFrame:
    """Marks the channels beyond the cap as ``dropped`` instead of losing them silently."""
    return scoped.withColumn("dropped", F.col("place") > most if most > 0 else F.lit(False))


def channel_union(analysis: DataFrame, report: DataFrame, forced: Sequence[str] = ()) -> DataFrame:
    """Channels of both outputs, the analysis' first, then forced ones not yet there."""
    parts = analysis.select("metric", F.struct(F.lit(0).alias("src"), F.col("place").alias("place")).alias("_at")) \
        .unionByName(report.select("metric", F.struct(F.lit(1).alias("src"), F.col("place").alias("place")).alias("_at")))
    if forced:
        names = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(m).alias("metric"))
                                    for i, m in enumerate(forced)]))
        extra = parts.sparkSession.range(1).select(names.alias("_f")).select(
            F.col("_f.metric").alias("metric"),
            F.struct(F.lit(2).alias("src"), F.col("_f.place").alias("place")).alias("_at"))
        parts = parts.unionByName(extra)
    first = parts.groupBy("metric").agg(F.min("_at").alias("_at"))
    return with_position(first, ["_at"]).select("metric", "place")


def keep_channels(readings: DataFrame, channels: DataFrame) -> DataFrame:
    """Readings of the given channels only."""
    return readings.join(channels.select("metric").distinct(), "metric", "left_semi")


def included(channels: DataFrame) -> DataFrame:
    return channels.where(F.coalesce("include", F.lit(True)))


def in_period(lo: str = "", hi: str = "", ts: str = "ts") -> Column:
    """Inclusive at both ends; an empty end is open. Rows without time are out."""
    test = F.col(ts).isNotNull()
    if lo:
        test = test & (F.col(ts) >= ntz(lo))
    if hi:
        test = test & (F.col(ts) <= ntz(hi))
    return test


def period_filter(readings: DataFrame, lo: str = "", hi: str = "") -> DataFrame:
    """Readings inside the period. Only their times decide: ``day`` is a file's, whose rows may reach far beyond it."""
    return readings.where(in_period(lo, hi)) if lo or hi else readings


def period_counts(readings: DataFrame, lo: str = "", hi: str = "") -> DataFrame:
    """How many rows the period keeps and drops."""
    test = in_period(lo, hi) if lo or hi else F.lit(True)
    return readings.groupBy().agg(F.count_if(test).alias("kept"), F.count_if(~test).alias("dropped"))


def data_range(readings: DataFrame) -> DataFrame:
    return readings.groupBy().agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def on_days(days: Sequence[str], lo: str = "", hi: str = "", ts: str = "ts") -> Column:
    """In the period and on one of the days; no days means all."""
    test = in_period(lo, hi, ts)
    if days:
        test = test & F.to_date(ts).isin(*[F.to_date(F.lit(d)) for d in days])
    return test


def hour_flag(date: str, from_hour: int, to_hour: int, ts: str = "ts") -> Column:
    """1 from the start hour to the end of the end hour on the date, else 0."""
    start = micros(ntz(f"{date} 00:00:00"))
    lo, hi = start + from_hour * HOUR_US, start + (to_hour + 1) * HOUR_US
    return F.when((F.col(ts) >= from_micros(lo)) & (F.col(ts) < from_micros(hi)), 1).otherwise(0)


def cut_table(table: DataFrame, days: Sequence[str] = (), lo: str = "", hi: str = "",
              date: str = "date") -> DataFrame:
    """A summary cut to days and period by its date; rows without a date stay."""
    day = F.to_date(date)
    test = F.lit(True)
    if days:
        test = test & day.isin(*[F.to_date(F.lit(d)) for d in days])
    if lo:
        test = test & (day >= F.to_date(F.lit(lo[:10])))
    if hi:
        test = test & (day <= F.to_date(F.lit(hi[:10])))
    return table.where(day.isNull() | test)


def prune(values: DataFrame, metrics: Sequence[str] = (), entities: Sequence[str] = (),
          days: Sequence[str] = (), lo: str = "", hi: str = "") -> DataFrame:
    """An export's share of the aligned values: channels, units and rows."""
    test = on_days(days, lo, hi)
    if metrics:
        test = test & F.col("metric").isin(*metrics)
    if entities:
        test = test & F.col("entity").isin(*entities)
    return values.where(test)
