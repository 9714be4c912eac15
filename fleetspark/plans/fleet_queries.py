"""Queries on alignment, deviation, charts and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.functions.timefn import bucket
from fleetspark.operators import align, reshape, select, series
from fleetspark.operators.ordered import fit_chunk, nearest
from fleetspark.params import ChartSpec, ColumnFilter
from fleetspark.plans.registry import query
from fleetspark.plans.views import (
    CHANNELS_SQL,
    ENTITIES,
    EV_SQL,
    METRICS,
    WIDE_CELLS_SQL,
    channels,
    day_files,
    day_files_sql,
    fleet_channels,
    fleet_channels_sql,
    raw_events,
    readings,
    readings_sql,
    shown,
    table,
    wide,
)
from fleetspark.sinks import tables as sinks

RD, R6 = readings_sql(), readings_sql("6 hours")
TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
FORMAT = "'%Y-%m-%d %H:%M:%S'"


def values(spark, sf, width="1 day"):
    """Daily values per unit, aligned; their grid is known."""
    return align.aligned(readings(spark, sf, width), grid=width)


# --- time grid --------------------------------------------------------------- #
@query("resample_mean", f"SELECT entity, metric, {TS}, value FROM ({R6})")
def resample_mean(spark, sf):
    return shown(readings(spark, sf, "6 hours").select("entity", "metric", "ts", "value"))


MODAL_SQL = """
  SELECT {keys}, interval_us FROM (
    SELECT {keys}, d AS interval_us, sum(count(*)) OVER (PARTITION BY {keys}) AS steps,
           row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, d) AS rn
    FROM (SELECT {keys}, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY {keys} ORDER BY ts, row_no)) AS d FROM {rows})
    WHERE d IS NOT NULL GROUP BY {keys}, d) WHERE rn = 1 AND steps >= 2
"""


@query("modal_interval", MODAL_SQL.format(keys="entity, metric", rows=f"({R6})"))
def modal_interval(spark, sf):
    return align.modal_interval(readings(spark, sf, "6 hours"), ["entity", "metric"])


SNAP_SQL = """
  SELECT metric, entity, strftime(make_timestamp(slot * {g}), '%Y-%m-%d %H:%M:%S') AS ts, round(v, 3) AS value FROM (
    SELECT metric, entity, slot, arg_min(value, (us, row_no)) AS v FROM (
      SELECT *, us // {g} + CASE WHEN 2 * (us % {g}) > {g} THEN 1 WHEN 2 * (us % {g}) < {g} THEN 0
                                 ELSE (us // {g}) % 2 END AS slot
      FROM (SELECT *, epoch_us(ts) AS us FROM {rows})) GROUP BY 1, 2, 3)
"""


@query("align_snap_dedup", SNAP_SQL.format(g=3_600_000_000, rows=f"({EV_SQL})"))
def align_snap_dedup(spark, sf):
    return shown(align.aligned(raw_events(spark, sf), grid="1 hour"))


@query("align_inferred_grid", SNAP_SQL.format(g=21_600_000_000, rows=f"({R6})"))
def align_inferred_grid(spark, sf):
    return shown(align.aligned(readings(spark, sf, "6 hours")))


# --- deviation --------------------------------------------------------------- #
BEST_SQL = f"""(SELECT metric, arg_min(entity, (-total, entity)) AS best FROM (
  SELECT metric, entity, sum(value) AS total FROM ({RD}) GROUP BY 1, 2) GROUP BY 1)"""


def deviation_sql(ref, percent=True, floor_abs=0.0):
    dev = ("CASE WHEN abs(ref) > greatest({f}, scale * 0.02) THEN round((value - ref) / ref * 100.0, 3) END"
           .format(f=floor_abs) if percent else "round(value - ref, 4)")
    return f"""
      SELECT metric, {TS}, entity, value, round(ref, 4) AS ref, {dev} AS deviation FROM (
        SELECT r.metric, ts, entity, value, {ref} OVER (PARTITION BY r.metric, ts) AS ref,
               max(abs(value)) OVER (PARTITION BY r.metric) AS scale
        FROM ({RD}) r JOIN {BEST_SQL} b ON r.metric = b.metric)"""


def deviation(spark, sf, mode="mean", percent=True, floor_abs=0.0):
    digits = 3 if percent else 4
    dev = align.deviation(values(spark, sf), mode, percent, floor_abs=floor_abs, round_to=digits)
    return shown(dev.withColumn("ref", F.round("ref", 4)))


@query("deviation_pct_mean", deviation_sql("avg(value)"))
def deviation_pct_mean(spark, sf):
    return deviation(spark, sf)


@query("deviation_pct_median", deviation_sql("median(value)"))
def deviation_pct_median(spark, sf):
    return deviation(spark, sf, "median")


@query("deviation_pct_max", deviation_sql("max(value)"))
def deviation_pct_max(spark, sf):
    return deviation(spark, sf, "max")


@query("deviation_pct_best", deviation_sql("max(CASE WHEN entity = best THEN value END)"))
def deviation_pct_best(spark, sf):
    return deviation(spark, sf, "best")


@query("deviation_abs", deviation_sql("avg(value)", percent=False))
def deviation_abs(spark, sf):
    return deviation(spark, sf, percent=False)


@query("deviation_floor", deviation_sql("median(value)", floor_abs=50.0))
def deviation_floor(spark, sf):
    return deviation(spark, sf, "median", floor_abs=50.0)


DEV_SQL = f"""(SELECT metric, ts, entity, value, CASE WHEN abs(ref) > scale * 0.02
     THEN round((value - ref) / ref * 100.0, 3) END AS deviation FROM (
   SELECT metric, ts, entity, value, avg(value) OVER (PARTITION BY metric, ts) AS ref,
          max(abs(value)) OVER (PARTITION BY metric) AS scale FROM ({RD})))"""


def dev(spark, sf):
    return align.deviation(values(spark, sf))


WORST_SQL = f"""
  SELECT metric, entity, stat, rank FROM (
    SELECT metric, entity, round(s, 6) AS stat,
           row_number() OVER (PARTITION BY metric ORDER BY abs(s) DESC, entity) AS rank
    FROM (SELECT metric, entity, coalesce(avg(deviation), 0) AS s FROM {DEV_SQL} GROUP BY 1, 2))"""


@query("worst_units", WORST_SQL + " WHERE rank <= 6")
def worst_units(spark, sf):
    return align.worst_units(dev(spark, sf)).select(
        "metric", "entity", F.round("stat", 6).alias("stat"), F.col("rank").cast("long").alias("rank"))


@query("unit_stats", f"SELECT metric, entity, round(coalesce(avg(deviation), 0), 6) AS stat FROM {DEV_SQL} GROUP BY 1, 2")
def unit_stats(spark, sf):
    return align.unit_stats(dev(spark, sf)).withColumn("stat", F.round("stat", 6))


ROWS_SQL = f"""
  SELECT metric, {TS}, count(value) AS n, round(max(value) - min(value), 6) AS spread,
         bool_and(value = 0) AS all_zero, coalesce(max(abs(deviation)), 0.0) AS max_deviation,
         count(deviation) AS n_deviation
  FROM {DEV_SQL} GROUP BY metric, ts"""


@query("row_spread", ROWS_SQL)
def row_spread(spark, sf):
    return shown(align.row_spread(dev(spark, sf)).withColumn("spread", F.round("spread", 6)))


@query("row_filter_value", f"SELECT * FROM ({ROWS_SQL}) WHERE n > 0 AND NOT all_zero AND spread >= 30")
def row_filter_value(spark, sf):
    kept = align.filter_rows(dev(spark, sf), hide_zero=True, min_spread=30.0)
    return shown(kept.withColumn("spread", F.round("spread", 6)))


@query("row_filter_deviation", f"SELECT * FROM ({ROWS_SQL}) WHERE n_deviation > 0 AND max_deviation >= 40")
def row_filter_deviation(spark, sf):
    kept = align.filter_rows(dev(spark, sf), min_spread=40.0, view="deviation")
    return shown(kept.withColumn("spread", F.round("spread", 6)))


@query("fleet_mean", f"SELECT metric, {TS}, round(avg(value), 4) AS mean FROM ({RD}) GROUP BY metric, ts")
def fleet_mean(spark, sf):
    return shown(align.fleet_mean(values(spark, sf)).withColumn("mean", F.round("mean", 4)))


@query("day_counts", f"""SELECT metric, strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT ts) AS rows
  FROM ({R6}) GROUP BY 1, 2""")
def day_counts(spark, sf):
    return shown(align.day_counts(readings(spark, sf, "6 hours")))


@query("kpis", f"""
  SELECT metric, sum(n)::BIGINT AS samples, arg_min(entity, (-mean, entity)) AS best, round(max(mean), 4) AS best_mean,
         arg_min(entity, (mean, entity)) AS worst, round(min(mean), 4) AS worst_mean,
         round(max(mean) - min(mean), 4) AS spread, sum(zeros)::BIGINT AS zeros
  FROM (SELECT metric, entity, count(value) AS n, avg(value) AS mean, count(*) FILTER (value = 0) AS zeros
        FROM ({RD}) GROUP BY 1, 2) GROUP BY 1""")
def kpis(spark, sf):
    out = align.kpis(values(spark, sf))
    for c in ("best_mean", "worst_mean", "spread"):
        out = out.withColumn(c, F.round(c, 4))
    return out


@query("shared_channels", "SELECT DISTINCT event_type AS metric, false AS shared FROM events "
       "UNION ALL SELECT * FROM (VALUES ('copy', true), ('SITE', true)) t(metric, shared)")
def shared_channels(spark, sf):
    """Channel copy holds one sensor for all units, SITE belongs to the plant alone."""
    day = values(spark, sf)
    one = fleet_channels(spark, sf, "1 day").where("metric = 'error'")
    units = F.explode(F.array(*[F.lit(f"U{i:02d}") for i in range(10)]))
    copies = one.select(F.lit("copy").alias("metric"), "ts", units.alias("entity"), "value")
    plant = one.select(F.lit("SITE").alias("metric"), "ts", F.lit("PLANT").alias("entity"), "value")
    return align.shared_channels(day.unionByName(copies).unionByName(plant))


# --- metrics worth comparing -------------------------------------------------- #
DF = day_files_sql()


def channel_files(spark, sf):
    rows = day_files(spark, sf)
    firsts = rows.groupBy("file", "metric").agg(F.count("value").alias("n"))
    pos = F.when(F.col("metric") == "click", 0).when(F.col("metric") == "error", 1).when(
        F.col("metric") == "purchase", 2).when(F.col("metric") == "signup", 3).otherwise(4)
    return firsts.select("file", F.col("file").alias("file_pos"), pos.alias("pos"), "metric",
                         (F.col("n") > 0).alias("is_numeric"))


@query("common_metrics", f"""
  SELECT metric, count(DISTINCT file) AS files FROM ({DF}) GROUP BY 1
  HAVING count(DISTINCT file) >= greatest(1, floor((SELECT count(DISTINCT file) FROM ({DF})) * 0.6))""")
def common_metrics(spark, sf):
    return align.common_metrics(channel_files(spark, sf)).select("metric", "files")


SPREAD_SQL = f"""
  SELECT row_number() OVER (ORDER BY spread DESC, metric DESC) AS rank, metric, round(spread, 6) AS spread FROM (
    SELECT metric, max(sd / (abs(mean) + 1e-9)) AS spread FROM (
      SELECT file, entity, metric, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS sd
      FROM ({DF}) GROUP BY 1, 2, 3) WHERE n > 2 GROUP BY 1)"""


@query("suggest_metrics", SPREAD_SQL + " QUALIFY rank <= 3")
def suggest_metrics(spark, sf):
    out = align.suggest_metrics(day_files(spark, sf), channel_files(spark, sf), limit=3)
    return out.select(F.col("rank").cast("long").alias("rank"), "metric", F.round("spread", 6).alias("spread"))


@query("suggest_wide_metrics", SPREAD_SQL.replace("WHERE n > 2", "WHERE n > 2 AND metric <> 'view'"))
def suggest_wide_metrics(spark, sf):
    out = align.suggest_wide_metrics(day_files(spark, sf), channels(spark, sf))
    return out.select(F.col("rank").cast("long").alias("rank"), "metric", F.round("spread", 6).alias("spread"))


# --- reshape ------------------------------------------------------------------- #
RF = fleet_channels_sql()


@query("matrix_pivot", f"""
  SELECT {TS}, {', '.join(f"max(CASE WHEN metric = '{m}' THEN value END) AS {m}" for m in METRICS)}
  FROM ({RF}) GROUP BY ts""")
def matrix_pivot(spark, sf):
    rows = fleet_channels(spark, sf).select(F.lit("m").alias("metric"), "ts", F.col("metric").alias("entity"), "value")
    return shown(align.matrix(rows, METRICS).drop("metric"))


def wide_layout_of(spark, sf, df):
    return reshape.layout(reshape.column_table(df), r"^(U\d+)_(.+)$", r"^ANN_\d+$", "ts")


@query("wide_unpivot", f"SELECT {TS}, entity, metric, value FROM ({WIDE_CELLS_SQL})")
def wide_unpivot(spark, sf):
    df = wide(spark, sf)
    cells = reshape.melt(df.withColumn("file", F.lit("wide")), ["file", "ts"])
    rows = reshape.unit_readings(cells, wide_layout_of(spark, sf, df), ["unit"])
    return shown(rows.select("ts", "entity", "metric", "value"))


@query("plant_channels", f"""
  SELECT {TS}, 'PLANT' AS entity, 'Site_temp' AS metric, value
  FROM ({fleet_channels_sql('1 day')}) WHERE metric = 'error'""")
def plant_channels(spark, sf):
    df = wide(spark, sf)
    cells = reshape.melt(df.withColumn("file", F.lit("wide")), ["file", "ts"])
    rows = reshape.unit_readings(cells, wide_layout_of(spark, sf, df))
    return shown(reshape.plant_readings(rows).select("ts", "entity", "metric", "value"))


@query("wide_layout", """
  SELECT entity || '_' || metric AS raw, 'unit' AS role, entity, metric, NULL AS alarm_entity
  FROM (SELECT DISTINCT 'U' || lpad((user_id % 10)::VARCHAR, 2, '0') AS entity FROM events)
  CROSS JOIN (SELECT DISTINCT event_type AS metric FROM events)
  UNION ALL
  SELECT 'ANN_' || substr(entity, 2) || '0' || j, 'alarm', NULL, 'ANN_' || substr(entity, 2) || '0' || j, entity
  FROM (SELECT DISTINCT 'U' || lpad((user_id % 10)::VARCHAR, 2, '0') AS entity FROM events)
  CROSS JOIN (SELECT row_number() OVER (ORDER BY event_type) AS j FROM (SELECT DISTINCT event_type FROM events))
  UNION ALL SELECT 'Site_temp', 'plant', 'PLANT', 'Site_temp', NULL UNION ALL SELECT 'ts', 'time', NULL, 'ts', NULL""")
def wide_layout(spark, sf):
    return wide_layout_of(spark, sf, wide(spark, sf)).select("raw", "role", "entity", "metric", "alarm_entity")


@query("guess_unit_pattern", r"""
  SELECT '^([A-Za-z]{2,6}\d{1,3})[_ ]+(.+)$' AS pattern, count(DISTINCT n_name) AS n_entities,
         (SELECT count(DISTINCT event_type) FROM events) AS n_metrics,
         count(DISTINCT n_name) * (SELECT count(DISTINCT event_type) FROM events) AS n_columns FROM nation""")
def guess_unit_pattern(spark, sf):
    """Headers NA00_click ... from nations and event types."""
    kinds = table(spark, sf, "events").select(F.col("event_type").alias("kind")).distinct()
    units = table(spark, sf, "nation").groupBy().agg(F.collect_set("n_nationkey").alias("keys"))
    pairs = kinds.withColumn("keys", units.scalar()).withColumn("key", F.explode("keys"))
    name = F.concat(F.lit("NA"), F.lpad(F.col("key").cast("string"), 2, "0"), F.lit("_"), F.col("kind"))
    cols = pairs.select(F.lit("f").alias("file"), name.alias("raw"))
    return reshape.guess_unit_pattern(cols).select("pattern", "n_entities", "n_metrics", "n_columns")


@query("tidy", f"""
  SELECT strftime(r.ts, {FORMAT}) AS time, r.entity, c.name AS metric, c.unit, r.value
  FROM ({RD}) r JOIN ({CHANNELS_SQL}) c ON r.metric = c.metric""")
def tidy(spark, sf):
    return shown(reshape.tidy(readings(spark, sf), channels(spark, sf)))


@query("entity_order", f"SELECT entity, row_number() OVER (ORDER BY entity) AS place FROM (SELECT DISTINCT entity FROM ({RD}))")
def entity_order(spark, sf):
    out = reshape.ordered_entities(readings(spark, sf))
    return out.withColumn("place", F.col("place").cast("long"))


@query("metric_specs", f"""
  SELECT metric, 'ch ' || metric AS name, 'U00' AS from_entity, true AS matched FROM ({CHANNELS_SQL}) WHERE metric <> 'click'
  UNION ALL SELECT 'click', 'ch click', 'U03', true""")
def metric_specs(spark, sf):
    """Raw column specs from the wide header; for click only unit 3 on is in the dictionary."""
    cols = wide_layout_of(spark, sf, wide(spark, sf))
    specs = cols.where("role = 'unit'").select(
        "raw", F.concat_ws(" ", "entity", F.lit("ch"), "metric").alias("name"), F.lit("kW").alias("unit"),
        F.lit("").alias("note"), F.lit("").alias("kind"), F.lit(False).alias("shared"), F.lit(True).alias("is_numeric"),
        F.lit(True).alias("include"), F.lit(None).cast("int").alias("decimals"),
        ((F.col("metric") != "click") | (F.col("entity") >= "U03")).alias("matched"))
    return reshape.metric_specs(cols, specs).select("metric", "name", "from_entity", "matched")


# --- selection ------------------------------------------------------------------ #
@query("period_filter_files", f"""SELECT row_no, entity, '2024-01-01' AS day FROM ({EV_SQL})
  WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'""")
def period_filter_files(spark, sf):
    """A month in one file: its day is that of its first row."""
    first = raw_events(spark, sf).groupBy("entity").agg(F.to_date(F.min("ts")).alias("day"))
    monthly = raw_events(spark, sf).join(first, "entity")
    kept = select.period_filter(monthly, "2024-01-15 00:00:00", "2024-01-20 12:00:00")
    return kept.select("row_no", "entity", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("period_filter", f"""SELECT row_no, entity, metric, value FROM ({EV_SQL})
  WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-12 18:30:00'""")
def period_filter(spark, sf):
    kept = select.period_filter(raw_events(spark, sf), "2024-01-05 06:00:00", "2024-01-12 18:30:00")
    return kept.select("row_no", "entity", "metric", "value")


@query("period_counts", f"""SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS kept,
  count(*) FILTER (ts < TIMESTAMP '2024-01-20') AS dropped FROM ({EV_SQL})""")
def period_counts(spark, sf):
    return select.period_counts(raw_events(spark, sf), lo="2024-01-20 00:00:00")


@query("data_range", f"SELECT strftime(min(ts), {FORMAT}) AS first_ts, strftime(max(ts), {FORMAT}) AS last_ts FROM events")
def data_range(spark, sf):
    return shown(select.data_range(raw_events(spark, sf)))


@query("day_set", f"""SELECT row_no, value FROM ({EV_SQL}) WHERE ts <= TIMESTAMP '2024-01-25 12:00:00'
  AND strftime(ts, '%Y-%m-%d') IN ('2024-01-03', '2024-01-10', '2024-01-25')""")
def day_set(spark, sf):
    test = select.on_days(["2024-01-03", "2024-01-10", "2024-01-25"], hi="2024-01-25 12:00:00")
    return raw_events(spark, sf).where(test).select("row_no", "value")


@query("hour_flag", f"""SELECT row_no, (CASE WHEN ts >= TIMESTAMP '2024-01-10 11:00:00'
  AND ts < TIMESTAMP '2024-01-10 14:00:00' THEN 1 ELSE 0 END)::INTEGER AS in_range FROM ({EV_SQL})""")
def hour_flag(spark, sf):
    return raw_events(spark, sf).select("row_no", select.hour_flag("2024-01-10", 11, 13).alias("in_range"))


@query("prune_export", f"""SELECT metric, {TS}, entity, value FROM ({RD})
  WHERE metric IN ('click', 'view') AND entity IN ('U01', 'U07') AND ts >= TIMESTAMP '2024-01-08'""")
def prune_export(spark, sf):
    return shown(select.prune(values(spark, sf), ["click", "view"], ["U01", "U07"], lo="2024-01-08 00:00:00"))


@query("column_filter", f"""SELECT metric, (metric = 'click') OR (contains(name, 'u') AND NOT contains(metric, 'sign')) AS include
  FROM ({CHANNELS_SQL})""")
def column_filter(spark, sf):
    flt = ColumnFilter(enabled=True, contains=("U",), exclude=("SIGN",))
    out = select.filter_columns(channels(spark, sf), flt, F.col("metric") == "click")
    return out.select("metric", "include")


@query("content_scope", f"""
  SELECT metric, row_number() OVER (ORDER BY CASE metric WHEN 'view' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, pos) AS place,
         row_number() OVER (ORDER BY CASE metric WHEN 'view' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, pos) > 3 AS dropped
  FROM ({CHANNELS_SQL}) WHERE include OR metric IN ('view', 'error')""")
def content_scope(spark, sf):
    scoped = select.content_scope(channels(spark, sf), "visible", ["view", "error"])
    return select.cap_channels(scoped, 3).select("metric", F.col("place").cast("long").alias("place"), "dropped")


@query("channel_union", f"""
  SELECT metric, row_number() OVER (ORDER BY CASE WHEN metric = 'view' THEN 0 ELSE 1 END, pos) AS place
  FROM ({CHANNELS_SQL}) WHERE include OR metric = 'view'
  UNION ALL SELECT 'error', (SELECT count(*) FROM ({CHANNELS_SQL}) WHERE include OR metric = 'view') + 1""")
def channel_union(spark, sf):
    ch = channels(spark, sf)
    both = select.channel_union(select.content_scope(ch, "selected", ["view"]),
                                select.content_scope(ch, "visible"), forced=["error", "view"])
    return both.withColumn("place", F.col("place").cast("long"))


@query("included_readings", f"SELECT entity, metric, {TS}, value FROM ({RD}) WHERE metric <> 'error'")
def included_readings(spark, sf):
    kept = select.keep_channels(readings(spark, sf), select.included(channels(spark, sf)))
    return shown(kept.select("entity", "metric", "ts", "value"))


# --- series for charts and reports ------------------------------------------------ #
THIN_SQL = """
  SELECT {cols}, step, rows_total FROM (
    SELECT *, CASE WHEN rows_total > {limit} THEN ceil(rows_total / {limit}::DOUBLE)::BIGINT ELSE 1 END AS step FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS pos,
             count(*) OVER (PARTITION BY {keys}) AS rows_total FROM {rows}))
  WHERE (pos - 1) % step = 0
"""


@query("thin_series", THIN_SQL.format(cols="row_no, entity, metric, value", keys="entity, metric", order="ts, row_no",
                                      limit=50, rows=f"({EV_SQL})"))
def thin_series(spark, sf):
    ev = raw_events(spark, sf)
    keys = ["entity", "metric"]
    out = series.thin(ev, keys, ["ts", "row_no"], 50, fit_chunk(ev, keys))
    return out.select("row_no", "entity", "metric", "value", "step", "rows_total")


@query("frame_payload", f"""
  SELECT r.metric, strftime(r.ts, {FORMAT}) AS ts, r.entity, r.value, k.step, k.rows_total FROM ({R6}) r
  JOIN ({THIN_SQL.format(cols='metric, ts', keys='metric', order='ts', limit=200, rows=f'(SELECT DISTINCT metric, ts FROM ({R6}))')}) k
  ON r.metric = k.metric AND r.ts = k.ts""")
def frame_payload(spark, sf):
    return shown(series.frame_payload(values(spark, sf, "6 hours"), max_points=100))


@query("extra_channels", f"""SELECT metric, {TS}, entity, value, 1 AS step, rows_total FROM (
  SELECT r.*, t.rows_total FROM ({RD}) r JOIN (SELECT metric, count(DISTINCT ts) AS rows_total FROM ({RD}) GROUP BY 1) t
  ON r.metric = t.metric WHERE r.metric NOT IN ('purchase', 'click'))""")
def extra_channels(spark, sf):
    return shown(series.extra_channels(values(spark, sf), ["purchase", "click"]))


@query("metric_entries", f"""
  SELECT r.metric, c.name AS title, c.unit, array_to_string(list_sort(list(DISTINCT entity)), ',') AS entities,
         count(DISTINCT ts) AS rows_total, count(DISTINCT ts) * count(DISTINCT entity) AS cells,
         r.metric = 'purchase' AS chosen, true AS has_deviation, false AS shared
  FROM ({RD}) r JOIN ({CHANNELS_SQL}) c ON r.metric = c.metric GROUP BY 1, 2, 3""")
def metric_entries(spark, sf):
    out = series.metric_entries(values(spark, sf), channels(spark, sf), ["purchase"])
    return out.withColumn("entities", F.array_join("entities", ","))


@query("table_head", f"""
  SELECT entity, metric, {TS}, value, (SELECT count(*) FROM ({RD})) AS rows_total, true AS truncated
  FROM ({RD}) ORDER BY value DESC, entity, metric, ts LIMIT 40""")
def table_head(spark, sf):
    rows = readings(spark, sf).select("entity", "metric", "ts", "value")
    return shown(series.table_head(rows, [F.desc("value"), "entity", "metric", "ts"], 40))


@query("pct_of_max", f"""
  SELECT metric, {TS}, entity, round(value / max(abs(value)) OVER (PARTITION BY metric, entity) * 100.0, 4) AS value
  FROM ({RD})""")
def pct_of_max(spark, sf):
    out = series.pct_of_max(values(spark, sf), ["metric", "entity"])
    return shown(out.withColumn("value", F.round("value", 4)).select("metric", "ts", "entity", "value"))


@query("gain_around_mean", f"""
  SELECT metric, {TS}, entity, round(m + 3 * (value - m), 4) AS value
  FROM (SELECT *, avg(value) OVER (PARTITION BY metric, entity) AS m FROM ({RD}))""")
def gain_around_mean(spark, sf):
    out = series.amplify(values(spark, sf), ["metric", "entity"], 3.0)
    return shown(out.withColumn("value", F.round("value", 4)).select("metric", "ts", "entity", "value"))


SEGMENT_DAYS = ["2024-01-02", "2024-01-05", "2024-01-06", "2024-01-20"]


@query("segments", f"""
  WITH t AS (SELECT DISTINCT metric, ts FROM ({R6})
             WHERE strftime(ts, '%Y-%m-%d') IN ({', '.join(f"'{d}'" for d in SEGMENT_DAYS)})),
  s AS (SELECT *, sum(new) OVER (PARTITION BY metric ORDER BY ts) AS segment FROM (
          SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY metric ORDER BY ts)) <= 32400000000
                         THEN 0 ELSE 1 END AS new FROM t)),
  g AS (SELECT metric, segment, min(ts) AS t0, max(ts) AS t1,
               greatest(21600000000, epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE AS w FROM s GROUP BY 1, 2)
  SELECT metric, segment::BIGINT AS segment, strftime(t0, {FORMAT}) AS t0, strftime(t1, {FORMAT}) AS t1,
         round((sum(w) OVER (PARTITION BY metric ORDER BY segment) - w) / sum(w) OVER (PARTITION BY metric), 6) AS w0,
         round(sum(w) OVER (PARTITION BY metric ORDER BY segment) / sum(w) OVER (PARTITION BY metric), 6) AS w1
  FROM g""")
def segments(spark, sf):
    rows = readings(spark, sf, "6 hours").where(select.on_days(SEGMENT_DAYS)).select("metric", "ts").distinct()
    out = series.segments(rows, "6 hours")
    return shown(out.withColumn("segment", F.col("segment").cast("long"))
                 .withColumn("w0", F.round("w0", 6)).withColumn("w1", F.round("w1", 6)))


@query("nearest_sample", f"""
  WITH ev AS ({EV_SQL}),
  k AS (SELECT DISTINCT entity, metric FROM ev),
  p AS (SELECT entity, metric, unnest(generate_series(
          (SELECT date_trunc('day', min(ts)) FROM ev), (SELECT max(ts) FROM ev), INTERVAL '1 hour')) AS ts FROM k),
  n AS (SELECT p.entity, p.metric, p.ts, b.ts AS bt, b.value AS bv FROM p ASOF LEFT JOIN ev b
        ON p.entity = b.entity AND p.metric = b.metric AND p.ts >= b.ts),
  m AS (SELECT n.*, a.ts AS nt, a.value AS av FROM n ASOF LEFT JOIN ev a
        ON n.entity = a.entity AND n.metric = a.metric AND n.ts <= a.ts)
  SELECT entity, metric, {TS}, CASE WHEN bt IS NULL OR epoch_us(nt) - epoch_us(ts) < epoch_us(ts) - epoch_us(bt)
         THEN av ELSE bv END AS value FROM m""")
def nearest_sample(spark, sf):
    """Every series' sample closest to each full hour."""
    ev = raw_events(spark, sf).select("entity", "metric", "ts", "value")
    keys = ev.select("entity", "metric").distinct()
    ends = select.data_range(ev).select(
        F.date_trunc("day", "first_ts").alias("lo"), F.col("last_ts").cast("timestamp").alias("hi"))
    hours = F.sequence(ends.select("lo").scalar(), ends.select("hi").scalar(), F.expr("INTERVAL 1 HOUR"))
    probes = keys.withColumn("ts", F.explode(hours)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return shown(nearest(probes, ev, ["entity", "metric"], "value").select("entity", "metric", "ts", "value"))


CHART = ChartSpec(title="Power", y_columns=("purchase", "click", "error"), entities=("U02", "U05"), max_points=20)


@query("chart_series", f"""
  SELECT t.entity, t.metric, t.entity || ' · ' || c.name AS label, c.unit, strftime(t.ts, {FORMAT}) AS ts, t.value AS y, t.step
  FROM ({THIN_SQL.format(cols='entity, metric, ts, value', keys='entity, metric', order='ts', limit=20,
        rows=f"(SELECT * FROM ({RD}) WHERE entity IN ('U02', 'U05') AND metric IN ('purchase', 'click', 'error'))")}) t
  JOIN ({CHANNELS_SQL}) c ON t.metric = c.metric""")
def chart_series(spark, sf):
    out = series.chart_series(readings(spark, sf), CHART, channels(spark, sf))
    return shown(out.select("entity", "metric", "label", "unit", "ts", "y", "step"))


@query("chart_xy", f"""
  SELECT y.entity, y.metric, x.value AS x, y.value AS y FROM ({RD}) y JOIN ({RD}) x
  ON x.entity = y.entity AND x.ts = y.ts AND x.metric = 'view' AND y.metric IN ('purchase', 'click')
  WHERE x.value IS NOT NULL AND y.value IS NOT NULL""")
def chart_xy(spark, sf):
    chart = ChartSpec(x_column="view", y_columns=("purchase", "click"))
    return series.chart_series(readings(spark, sf), chart, channels(spark, sf)).select("entity", "metric", "x", "y")



@query("chart_groups", f"""
  SELECT p.pattern AS chart, c.unit AS axis_unit, r.entity, r.metric, count(*) AS points
  FROM ({RD}) r JOIN ({CHANNELS_SQL}) c ON r.metric = c.metric
  JOIN (VALUES ('CH P'), ('click'), ('er')) p(pattern)
    ON contains(c.metric, lower(p.pattern)) OR contains(c.name, lower(p.pattern))
  WHERE r.metric IN ('purchase', 'click', 'error') GROUP BY 1, 2, 3, 4""")
def chart_groups(spark, sf):
    chart = ChartSpec(y_columns=("purchase", "click", "error"), group_mode="pattern", patterns=("CH P", "click", "er"))
    out = series.group_series(series.chart_series(readings(spark, sf), chart, channels(spark, sf)), chart)
    return out.groupBy("chart", "axis_unit", "entity", "metric").agg(F.count("y").alias("points"))


@query("overlay", f"""
  SELECT metric, {TS}, entity, value FROM ({RD}) WHERE metric = 'view'
  UNION ALL SELECT metric, {TS}, 'FLEET', value FROM ({RF}) WHERE metric = 'error'""")
def overlay(spark, sf):
    return shown(series.overlay(values(spark, sf).where("metric = 'view'"),
                                fleet_channels(spark, sf).where("metric = 'error'")))


@query("cleaned_readings", f"""SELECT r.entity, strftime(r.ts, {FORMAT}) AS ts, c.name, c.unit, r.metric AS raw, r.value
  FROM ({RD}) r JOIN ({CHANNELS_SQL}) c ON r.metric = c.metric WHERE c.include""")
def cleaned_readings(spark, sf):
    rows = readings(spark, sf).withColumn("day", F.to_date("ts")).withColumn("text", F.lit(None).cast("string"))
    return shown(sinks.cleaned(rows, channels(spark, sf)).select("entity", "ts", "name", "unit", "raw", "value"))


@query("view_table", f"""SELECT {TS}, {', '.join(f"max(value) FILTER (entity = '{e}') AS {e}" for e in ENTITIES)} FROM ({RD})
  WHERE metric = 'view' AND ts >= TIMESTAMP '2024-01-10' AND strftime(ts, '%Y-%m-%d') IN ('2024-01-05', '2024-01-12', '2024-01-20')
  GROUP BY ts""")
def view_table(spark, sf):
    return sinks.view_csv(values(spark, sf), "view", ENTITIES, days=["2024-01-05", "2024-01-12", "2024-01-20"], lo="2024-01-10 00:00:00")


@query("bucket_grid", "SELECT event_id, strftime(time_bucket(INTERVAL '15 minutes', ts), '%Y-%m-%d %H:%M:%S') AS bin FROM events")
def bucket_grid(spark, sf):
    return shown(table(spark, sf, "events").select("event_id", bucket("ts", "15 minutes").alias("bin")))
