"""The whole run as a Spark job: a folder of exports in, a folder of tables out.

``spark-submit fleetspark/plans/job.py INPUT OUTPUT`` with the package on the path.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.operators import align, diagnostics, reshape, rules, select, summaries
from fleetspark.operators import dictionary as dic
from fleetspark.operators.ordered import sized
from fleetspark.operators.select import filter_columns
from fleetspark.params import (
    PLANT,
    AnalysisParams,
    ColumnFilter,
    DictionaryParams,
    IdentityParams,
    ReaderParams,
    Rule,
    default_rules,
)
from fleetspark.session import pin_time_zone
from fleetspark.sinks import tables as sinks
from fleetspark.sources import files as fl
from fleetspark.sources import ingest as ing
from fleetspark.sources.lines import read_lines


@dataclass(frozen=True)
class JobParams:
    reader: ReaderParams = ReaderParams()
    identity: IdentityParams = IdentityParams()
    dictionary: DictionaryParams = DictionaryParams()
    analysis: AnalysisParams = AnalysisParams()
    column_filter: ColumnFilter = ColumnFilter()
    rules: Sequence[Rule] = field(default_factory=default_rules)
    metrics: Sequence[str] = ()
    scope: str = "visible"
    most_channels: int = 12
    dictionary_path: str | None = None


def wide_layout(data: ing.Ingested, identity: IdentityParams) -> DataFrame:
    """Layout of every file's columns, with patterns as given or guessed for each kind of file."""
    cols = data.columns.select("file", F.col("idx").alias("pos"), "raw", "is_time").where("n > 0")
    pattern, alarm = identity.entity_from_column, identity.alarm_pattern
    named = cols.where(~F.col("is_time"))
    if pattern and alarm:
        out = reshape.layout(named, pattern, alarm)
    else:
        kinds = sized(reshape.header_kinds(cols))
        bits = data.readings.where(F.col("metric").rlike(reshape.BIT_PATTERN)).select("file", F.col("metric").alias("raw"), "value")
        guessed = sized(reshape.guess_patterns(named.select("file", "pos", "raw"), bits, kinds))
        out = reshape.layout(named.join(guessed, "file"), pattern or F.col("pattern"), alarm or F.col("alarm_pattern")).drop("pattern", "alarm_pattern")
    wide = reshape.wide_files(out).select("file", "is_wide")
    return out.join(wide, "file")


def split_units(data: ing.Ingested, layouts: DataFrame) -> DataFrame:
    """Readings per unit: columns of wide files go to their unit, other files stay as they are."""
    known = sized(layouts.select("file", F.col("raw").alias("metric"), "role", "is_wide",
                                 F.col("entity").alias("_entity"), F.col("metric").alias("_metric"), "alarm_entity"))
    rows = data.readings.join(known, ["file", "metric"])
    in_unit = F.col("is_wide")
    return (
        rows.withColumn("raw", F.col("metric"))
        .withColumn("entity", F.when(in_unit, F.coalesce("_entity", "alarm_entity", F.lit(PLANT))).otherwise(F.col("entity")))
        .withColumn("metric", F.when(in_unit, F.col("_metric")).otherwise(F.col("metric")))
        .drop("_entity", "_metric", "alarm_entity")
    )


def run(spark: SparkSession, folder: str, out: str, params: JobParams = JobParams()) -> dict[str, DataFrame]:
    """Reads, translates, analyses; writes readings first and works on what was written."""
    pin_time_zone(spark)
    listing = fl.discover(spark, folder)
    dict_path = params.dictionary_path
    if dict_path is None:
        found = fl.find_dictionary(listing).first()
        dict_path = found["path"] if found else None
    chosen = fl.eligible(listing, dict_path, out_dir=out)
    paths = [r["path"] for r in chosen.where("skip_reason is null").orderBy("pos").select("path").collect()]
    if not paths:
        raise ValueError(f"no input files in {folder}")
    data = ing.ingest_files(spark, paths, params.reader, params.identity, chosen.where("skip_reason is null"))

    layouts = wide_layout(data, params.identity)
    split = split_units(data, layouts)
    sinks.write_by_date(split, f"{out}/readings")
    stored = sinks.read_by_date(spark, f"{out}/readings", params.analysis.time_from, params.analysis.time_to)
    bits = stored.where("role = 'alarm' and is_wide")
    readings = stored.where("role <> 'alarm' or not is_wide")

    channels = translate_columns(spark, data, layouts, dict_path, params)
    units = reshape.units_only(readings)
    files = sized(chosen.select(F.col("path").alias("file"), F.col("pos").alias("file_pos")))
    channel_files = (
        units.where("value is not null").select("file", "metric").distinct().join(files, "file")
        .join(channels.select("metric", "pos", "is_numeric"), "metric")
    )
    a = params.analysis
    metrics = list(params.metrics)
    if not metrics and not layouts.where("is_wide").isEmpty():
        # wide files: what varies and is not one sensor for all units
        metrics = [r["metric"] for r in align.suggest_wide_metrics(units, channels).orderBy("rank").collect()]
    if not metrics:
        metrics = [r["metric"] for r in align.suggest_metrics(units, channel_files).orderBy("rank").collect()]
    scoped = select.cap_channels(select.content_scope(channels, params.scope, metrics), params.most_channels)
    values = align.aligned(readings.where(F.col("metric").isin(*metrics)), round_to=a.round_to)
    deviation = align.deviation(values, a.deviation_mode, a.deviation_percent, a.deviation_floor_pct, a.deviation_floor_abs, a.round_to)
    roles = dict(a.roles) or {r["role"]: r["metric"] for r in diagnostics.guess_roles(channels).collect()}
    daily = summaries.daily_summary(units.where(F.col("metric").isin(*metrics)), channels, a.round_to)
    # a column for each unit, in their natural order
    names = [r["entity"] for r in reshape.ordered_entities(reshape.units_only(values)).orderBy("place").collect()]
    results = {
        "value_matrix": align.matrix(reshape.units_only(deviation), names),
        "deviation_matrix": align.matrix(reshape.units_only(deviation), names, "deviation"),
        "values": values,
        "deviation": deviation,
        "kpis": align.kpis(reshape.units_only(values)),
        "shared": align.shared_channels(values),
        "long": reshape.tidy(readings, channels),
        "scope": scoped.select("metric", "place", "dropped"),
        "worst_units": align.worst_units(deviation),
        "daily": daily,
        "ranking": summaries.unit_ranking(daily),
        "zeros": summaries.zero_order(summaries.zero_report(units.where("value is not null or text is null"))),
        "quality": summaries.quality_report(units, data.files),
        "flags": rules.collect_flags(readings, channels, params.rules, a.flag_exclude),
        "alarms": summaries.alarm_order(summaries.alarm_summary(bits.withColumn("bit", F.col("raw")), channels)),
        "channels": channels,
        "files": data.files,
    }
    if "ac_power" in roles:
        unit_table = diagnostics.unit_table(units, roles, a)
        attribution = diagnostics.attribution(unit_table)
        results |= {"attribution": attribution, "efficiency": diagnostics.efficiency(unit_table),
                    "performance": diagnostics.performance(unit_table)}
        if "irradiance" in roles:
            lost = diagnostics.availability(units, roles, a)
            results |= {"availability": lost, "scatter": diagnostics.scatter_points(units, roles),
                        "findings": diagnostics.findings(attribution, lost)}
    results["run_info"] = sinks.run_info(
        spark, {"input": folder, "files": len(paths), "dictionary": dict_path, "metrics": ", ".join(metrics),
                "roles": ", ".join(f"{k}={v}" for k, v in roles.items()), "period": f"{a.time_from} - {a.time_to}"})
    sinks.write_tables(results, out)
    sinks.write_cleaned(readings, channels, f"{out}/cleaned")
    sinks.write_by_entity(readings, channels, results["alarms"], f"{out}/units")
    return {name: spark.read.parquet(f"{out}/{name}") for name in results}


def translate_columns(spark: SparkSession, data: ing.Ingested, layouts: DataFrame, dict_path: str | None,
                      params: JobParams) -> DataFrame:
    """One description per channel: by the dictionary, the unit row and the column filter."""
    cols = data.columns.where("n > 0").select(
        F.lit("dictionary").alias("file"), F.col("file").alias("file_pos"), F.col("idx").alias("pos"), "raw",
        (F.col("is_numeric") | F.col("is_time")).alias("is_numeric"), "unit_row")
    if dict_path:
        cells = ing.dictionary_cells(spark, read_lines(spark, dict_path), params.reader)
        entries = dic.entries(dic.extract_entries(cells, params.dictionary)).withColumn("file", F.lit("dictionary"))
    else:
        entries = dic.entries(spark.createDataFrame(
            [], "file string, ord long, key string, name string, unit string, note string, kind string, shared boolean"))
    translated = dic.translate(cols.select("file", "pos", "raw"), entries, params.dictionary)
    raw = dic.build_channels(cols, translated)
    time_columns = data.columns.where("is_time").select("raw").distinct()
    raw = filter_columns(raw.join(time_columns, "raw", "left_anti"), params.column_filter)
    named = layouts.where("is_wide")
    specs = reshape.metric_specs(named, raw, params.identity.strip_entity_in_name).drop("from_entity")
    place = raw.join(named.where("role = 'unit'").select("raw", F.col("metric").alias("_m")).distinct(), "raw") \
        .groupBy(F.col("_m").alias("metric")).agg(F.min("pos").alias("pos"))
    per_unit = specs.join(place, "metric").withColumn("raw", F.col("metric"))
    own = raw.join(named.where("role = 'unit'").select("raw").distinct(), "raw", "left_anti")
    keep = ["metric", "pos", "raw", "name", "unit", "note", "kind", "shared", "is_numeric", "include", "decimals", "matched"]
    return sized(own.select(*keep).unionByName(per_unit.select(*keep)))


def main(argv: Sequence[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description="Fleet telemetry analysis on Spark")
    ap.add_argument("input")
    ap.add_argument("output")
    ap.add_argument("--dictionary")
    ap.add_argument("--metrics", default="")
    ap.add_argument("--from", dest="time_from", default="")
    ap.add_argument("--to", dest="time_to", default="")
    ap.add_argument("--min-irradiance", type=float, default=0.4)
    args = ap.parse_args(argv)
    analysis = replace(AnalysisParams(), time_from=args.time_from, time_to=args.time_to, stable_min_irradiance=args.min_irradiance)
    params = JobParams(analysis=analysis, dictionary_path=args.dictionary, metrics=tuple(m for m in args.metrics.split(",") if m))
    spark = SparkSession.builder.appName("fleetspark").getOrCreate()
    run(spark, args.input, args.output, params)


if __name__ == "__main__":
    main()
