"""Wide files, one column per unit and channel, turned into long readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.functions.text import strip_entity
from fleetspark.operators.align import entity_number
from fleetspark.operators.ordered import with_position
from fleetspark.params import PLANT

# Shapes of "<unit>_<channel>" headers and of status bits, in order of preference.
UNIT_PATTERNS = (
    r"^(PCS\d+)[_ ]+(.+)$",
    r"^([A-Za-z]{2,6}\d{1,3})[_ ]+(.+)$",
    r"^(\d{1,3})[_ ]+(.+)$",
)
BIT_PATTERN = r"^[A-Za-z]{2,6}_\d{3,5}$"


def column_table(df: DataFrame, file: str = "wide") -> DataFrame:
    """The header of a wide table as rows: file, pos, raw."""
    rows = [(file, i, c) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "file string, pos int, raw string")


def guess_unit_pattern(columns: DataFrame, min_entities: int = 2, min_metrics: int = 2) -> DataFrame:
    """Per file the pattern that explains most columns: file, pattern, n_entities, n_metrics, n_columns."""
    tried = F.explode(F.array(*[
        F.when(F.col("raw").rlike(p), F.struct(
            F.lit(i).alias("no"), F.lit(p).alias("pattern"),
            F.regexp_extract("raw", p, 1).alias("entity"), F.regexp_extract("raw", p, 2).alias("metric")))
        for i, p in enumerate(UNIT_PATTERNS)]))
    per_pattern = (
        columns.select("file", tried.alias("_t")).where("_t is not null")
        .select("file", "_t.*")
        .groupBy("file", "no", "pattern").agg(
            F.countDistinct("entity").alias("n_entities"), F.countDistinct("metric").alias("n_metrics"),
            F.countDistinct("entity", "metric").alias("n_columns"))
        .where((F.col("n_entities") >= min_entities) & (F.col("n_metrics") >= min_metrics))
    )
    best = F.max_by(F.struct("pattern", "n_entities", "n_metrics", "n_columns"),
                    F.struct(F.col("n_columns"), -F.col("no")))
    return per_pattern.groupBy("file").agg(best.alias("_b")).select("file", "_b.*")


def guess_alarm_pattern(columns: DataFrame, readings: DataFrame, min_names: int = 8, min_binary: int = 5) -> DataFrame:
    """Per file the pattern of its 0/1 status-bit columns, if it has enough: file, alarm_pattern. All columns are looked at.

    ``readings`` holds the columns' values as file, raw, value.
    """
    named = columns.where(F.col("raw").rlike(BIT_PATTERN)).withColumn("_prefix", F.split("raw", "_")[0])
    first = named.groupBy("file").agg(F.min_by("_prefix", "pos").alias("_first"))
    names = named.join(first, "file").groupBy("file", "_first").agg(
        F.count(F.lit(1)).alias("_names"), F.count_if(F.col("_prefix") == F.col("_first")).alias("_same"))
    binary = (
        readings.join(named.select("file", "raw"), ["file", "raw"], "left_semi")
        .groupBy("file", "raw").agg(F.bool_and(F.col("value").isin(0.0, 1.0)).alias("_bit"))
        .groupBy("file").agg(F.count_if("_bit").alias("_binary"))
    )
    pattern = F.when(F.col("_same") >= F.col("_names") * 0.8,
                     F.concat(F.lit("^"), F.col("_first"), F.lit(r"_\d+$"))).otherwise(BIT_PATTERN)
    return (
        names.join(binary, "file")
        .where((F.col("_names") >= min_names) & (F.col("_binary") >= min_binary))
        .select("file", pattern.alias("alarm_pattern"))
    )


def header_kinds(columns: DataFrame) -> DataFrame:
    """Files of equal headers are of one kind: file, kind."""
    header = F.array_sort(F.collect_list(F.struct("pos", "raw")))
    return columns.groupBy("file").agg(F.xxhash64(F.to_json(header)).cast("string").alias("kind"))


def guess_patterns(columns: DataFrame, readings: DataFrame, kinds: DataFrame) -> DataFrame:
    """Unit and alarm pattern of every file, "" where it has none: file, pattern, alarm_pattern. Files of one kind are judged
    together, by the columns they share and by the values of all of them."""
    per_kind = columns.join(kinds, "file").select(F.col("kind").alias("file"), "pos", "raw").distinct()
    units = guess_unit_pattern(per_kind).select(F.col("file").alias("kind"), "pattern")
    cells = readings.join(kinds, "file").select(F.col("kind").alias("file"), "raw", "value")
    alarms = guess_alarm_pattern(per_kind, cells).withColumnRenamed("file", "kind")
    return (
        kinds.join(units, "kind", "left").join(alarms, "kind", "left")
        .select("file", F.coalesce("pattern", F.lit("")).alias("pattern"), F.coalesce("alarm_pattern", F.lit("")).alias("alarm_pattern"))
    )


def _entity_metric(raw: Column, pattern: Column, groups: int) -> tuple[Column, Column]:
    def part(n):
        return F.call_function("regexp_extract", raw, pattern, F.lit(n))

    entity = part(1)
    if groups > 1:
        metric = part(2)
    else:
        metric = F.regexp_replace(F.substr(raw, F.position(entity, raw) + F.length(entity)), "^[_ ]+", "")
    return entity, F.when(metric == "", raw).otherwise(metric)


def layout(columns: DataFrame, entity_pattern: str | Column = "", alarm_pattern: str | Column = "",
           time_column: str | None = None, groups: int = 2) -> DataFrame:
    """Adds role (time, alarm, unit, plant), entity, metric and alarm_entity to a column table.

    The alarm test comes first. A bit belongs to the unit whose number is left when
    the last two digits of its own number are dropped, otherwise to the plant. A
    pattern may be a column, so that every file has its own; "" matches nothing.
    """
    raw = F.col("raw")
    time = F.lit(False) if time_column is None else raw == time_column

    def matches(pattern):
        if isinstance(pattern, str):
            return raw.rlike(pattern) if pattern else F.lit(False)
        return F.when(pattern != "", F.rlike(raw, pattern)).otherwise(False)

    given = F.lit(entity_pattern) if isinstance(entity_pattern, str) else entity_pattern
    role = F.when(time, "time").when(matches(alarm_pattern), "alarm").when(matches(entity_pattern), "unit").otherwise("plant")
    out = columns.withColumn("role", role).withColumn("_pattern", F.when(F.col("role") == "unit", given))
    entity, metric = _entity_metric(raw, F.col("_pattern"), groups)
    out = (
        out.withColumn("entity", F.when(F.col("role") == "unit", entity).when(F.col("role") == "plant", PLANT))
        .withColumn("metric", F.when(F.col("role") == "unit", metric).otherwise(raw)).drop("_pattern")
    )
    digits = F.regexp_extract("raw", r"(\d+)\D*$", 1)
    number = F.when((F.col("role") == "alarm") & (F.length(digits) >= 3),
                    F.substr(digits, F.lit(1), F.length(digits) - 2).cast("decimal(38,0)"))
    units = (
        out.where("role = 'unit'").select("file", "entity", entity_number("entity").alias("_no")).distinct()
        .where("_no is not null").groupBy("file", "_no").agg(F.max("entity").alias("_unit"))
    )
    return (
        out.withColumn("_no", number).join(units, ["file", "_no"], "left")
        .withColumn("alarm_entity", F.when(F.col("role") == "alarm", F.coalesce("_unit", F.lit(PLANT))))
        .drop("_no", "_unit")
    )


def wide_files(layouts: DataFrame) -> DataFrame:
    """Files that hold several units: more than one unit and at least one channel."""
    return layouts.groupBy("file").agg(
        F.countDistinct(F.when(F.col("role") == "unit", F.col("entity"))).alias("n_entities"),
        F.countDistinct(F.when(F.col("role") == "unit", F.col("metric"))).alias("n_metrics"),
        F.count_if(F.col("role") == "plant").alias("n_plant"),
        F.count_if(F.col("role") == "alarm").alias("n_alarm"),
    ).withColumn("is_wide", (F.col("n_entities") > 1) & (F.col("n_metrics") > 0))


def melt(wide: DataFrame, ids: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Long rows raw, value of a wide table, map-side; a null cell stays a row."""
    values = [c for c in (columns or wide.columns) if c not in ids]
    numbers = [F.col(c).cast("double").alias(c) for c in values]
    return wide.select(*ids, *numbers).unpivot([F.col(i) for i in ids], [F.col(c) for c in values], "raw", "value")


def unit_readings(cells: DataFrame, layouts: DataFrame, roles: Sequence[str] = ("unit", "plant")) -> DataFrame:
    """Long cells given their unit and channel. ``cells`` has file, raw, value.

    The layout has a row per column of the file and is joined to every cell.
    """
    kept = layouts.where(F.col("role").isin(*roles)).select("file", "raw", "entity", "metric")
    return cells.join(kept, ["file", "raw"])


def alarm_cells(cells: DataFrame, layouts: DataFrame) -> DataFrame:
    """The status bits of long cells: entity, bit, value."""
    kept = layouts.where("role = 'alarm'").select(
        "file", "raw", F.col("alarm_entity").alias("entity"), F.col("raw").alias("bit"))
    return cells.join(kept, ["file", "raw"]).drop("raw")


def plant_readings(readings: DataFrame) -> DataFrame:
    return readings.where(F.col("entity") == PLANT)


def units_only(readings: DataFrame) -> DataFrame:
    """Without the plant pseudo-unit, which is no member of the fleet."""
    return readings.where(F.col("entity") != PLANT)


def ordered_entities(readings: DataFrame) -> DataFrame:
    """Units in their natural order: by first number, those without one last."""
    return with_position(readings.select("entity").distinct(), [entity_number("entity").asc_nulls_last(), F.col("entity")])


def metric_specs(layouts: DataFrame, channels: DataFrame, strip: bool = True) -> DataFrame:
    """One spec per unit channel: that of the first matched unit, else of the first; no unit prefix.

    ``channels`` describes raw columns: raw, name, unit, note, kind, shared, is_numeric,
    include, decimals, matched.
    """
    fields = ["name", "unit", "note", "kind", "shared", "is_numeric", "include", "decimals", "matched"]
    no = F.coalesce(entity_number("entity"), F.lit("9" * 38).cast("decimal(38,0)"))
    rows = layouts.where("role = 'unit'").select("raw", "entity", "metric").distinct().join(channels.select("raw", *fields), "raw")
    first = F.min_by(F.struct("entity", *fields), F.struct(~F.col("matched"), no, F.col("entity")))
    out = rows.groupBy("metric").agg(first.alias("_s")).select("metric", "_s.*")
    if strip:
        out = out.withColumn("name", strip_entity("name", "entity"))
    name = F.coalesce(F.nullif("name", F.lit("")), "metric")
    return out.withColumn("name", name).withColumnRenamed("entity", "from_entity")


def tidy(readings: DataFrame, channels: DataFrame | None = None, metrics: Sequence[str] = (),
         limit: int | None = None) -> DataFrame:
    """Long export: time, entity, metric name, unit, value. Whole unless ``limit`` is given."""
    rows = readings.where(F.col("metric").isin(*metrics)) if metrics else readings
    if channels is not None:
        rows = rows.join(channels.select("metric", "name", "unit"), "metric", "left")
    else:
        rows = rows.withColumn("name", F.lit(None).cast("string")).withColumn("unit", F.lit(""))
    out = rows.select(
        F.col("ts").alias("time"), "entity",
        F.coalesce(F.nullif("name", F.lit("")), "metric").alias("metric"),
        F.coalesce("unit", F.lit("")).alias("unit"), "value")
    return out if limit is None else out.limit(limit)
