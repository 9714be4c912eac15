"""Runs the headline queries and prints one JSON line with their times."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetspark.plans import catalog  # noqa: E402

HEADLINE = [
    "worst_units", "resample_mean", "align_snap_dedup", "align_inferred_grid", "modal_interval", "deviation_pct_median",
    "wide_unpivot", "daily_summary", "zero_report", "quality_gaps", "alarm_summary", "rule_sigma", "rule_jump", "rule_stuck",
    "rule_top_n", "rule_bottom_percent", "rule_duplicate", "flags_all", "flags_raw_events", "scale_percent", "unit_table_steady",
    "attribution", "availability", "nearest_sample", "thin_series", "chart_series", "segments", "dict_cascade", "ingest_readings",
]


#: A day of minutes of a wide logger file, and how many of them.
WIDE_COLUMNS, WIDE_ROWS, WIDE_FILES = 689, 1440, 8


def wide_cells_per_sec(spark, folder):
    """How fast files of the shape of a day's export are read; not among the queries, since its input is made here."""
    from fleetspark.sources import ingest as ing

    os.makedirs(folder)
    for n in range(WIDE_FILES):
        with open(f"{folder}/{n:03d}_2026-08-{n + 1:02d}.csv", "w") as f:
            f.write(",".join(["time", *(f"PCS{c // 14:02d}_Data{c % 14:02d}" for c in range(1, WIDE_COLUMNS))]) + "\n")
            for m in range(WIDE_ROWS):
                stamp = f"2026-08-{n + 1:02d} {m // 60:02d}:{m % 60:02d}:00"
                f.write(",".join([stamp, *(str((c * 7919 + m * 31) % 5000 / 10) for c in range(1, WIDE_COLUMNS))]) + "\n")
    start = time.perf_counter()
    ing.ingest_files(spark, [folder]).readings.write.format("noop").mode("overwrite").save()
    return round(WIDE_COLUMNS * WIDE_ROWS * WIDE_FILES / (time.perf_counter() - start))


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="fleetspark-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("fleetspark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{shared}/checkpoints")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["data_range"](spark, sf_dir).collect()
    only = sys.argv[1:]
    times, cells = {}, 0
    for name in only or HEADLINE:
        start = time.perf_counter()
        rows = catalog.QUERIES[name](spark, sf_dir)
        rows.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    wide = None if only else wide_cells_per_sec(spark, f"{shared}/wide")
    if "ingest_readings" in times:
        # four cells per event line
        cells = 4 * spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({
        "metric": "total query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1],
        "ingest_cells_per_sec": round(cells / times["ingest_readings"]) if cells else None, "wide_cells_per_sec": wide,
    }))


if __name__ == "__main__":
    main()
