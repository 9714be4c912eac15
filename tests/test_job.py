"""The whole run on planted faults, and on a wide file."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetspark.params import AnalysisParams, IdentityParams
from fleetspark.plans import job
from fleetspark.sinks import tables as sinks
from tests import fixtures

DICTIONARY = ("項目表\n\nCSV項目名称,項目名称,単位,備考\nDC_KW,①直流電力,kW,\nAC_KW,①交流電力,kW,\nIRR,日射量,W/m2,共通\n"
              "TEMP_INV,モジュール温度,℃,\n")


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder, out = (str(tmp_path_factory.mktemp(n)) for n in ("in", "out"))
    fixtures.write_units(folder)
    fixtures.write_text(folder, "CSV項目名称.csv", DICTIONARY, "cp932")
    params = job.JobParams(analysis=AnalysisParams(stable_min_irradiance=400.0, capacity_kw=2200.0), metrics=("AC_KW", "DC_KW"))
    return job.run(spark, folder, out, params)


def test_weak_unit_is_blamed(run):
    rows = run["attribution"].orderBy("rank").collect()
    assert rows[0].entity == "PCS003" and rows[0].verdict.startswith("DC side (array")
    assert rows[0].dc_vs_fleet_pct == pytest.approx(100 * (0.72 / 0.985 - 1), abs=0.3)
    assert all(r.efficiency_pct == pytest.approx(98.5, abs=0.01) for r in rows)
    assert 0 < rows[0].pr < 1


def test_outage_is_priced(run):
    rows = {r.entity: r for r in run["availability"].collect()}
    assert rows["PCS003"].zero_output == 240 and rows["PCS003"].missing == 0
    assert rows["PCS001"].zero_output == rows["PCS001"].missing == 120
    assert rows["PCS002"].zero_output == 0 and rows["PCS002"].availability_pct == 100.0
    assert rows["PCS003"].rank == 1 and rows["PCS003"].lost_kwh > rows["PCS001"].lost_kwh > 0
    sentences = [r.finding for r in run["findings"].orderBy("pos").collect()]
    assert sentences[0].startswith("PCS003: AC energy -") and "240 minute(s) with no output" in sentences[-1]


def test_tables(run, spark):
    channels = {r.metric: r for r in run["channels"].collect()}
    assert channels["AC_KW"].name == "①交流電力" and channels["IRR"].shared and channels["PF"].unit == ""
    assert channels["TEMP_INV"].unit == "℃" and not channels["STATUS"].is_numeric
    daily = {(r.entity, str(r.date), r.metric): r for r in run["daily"].collect()}
    d = daily[("PCS001", "2026-08-06", "DC_KW")]
    assert (d.samples, d.expected, d.coverage_pct, d.missing) == (1380, 1440, round(1380 / 14.4, 2), 0)
    info = {r.key: r.value for r in run["run_info"].collect()}
    assert info["files"] == "6" and info["dictionary"].endswith("CSV項目名称.csv")
    zeros = {(r.entity, r.metric): r for r in run["zeros"].where("file like '%08-06.csv'").collect()}
    assert zeros[("PCS003", "DC_KW")].longest_zero_run >= 300
    assert run["worst_units"].where("metric = 'AC_KW' and rank = 1").first().entity == "PCS003"


def wide_text():
    cols = [f"PCS{u:02d}_Data{c:02d}" for u in range(1, 5) for c in range(1, 4)] + ["Opt_21", "Opt_22"] + [
        f"ANN_{u}{b:02d}" for u in (1, 2, 9) for b in range(1, 5)]
    lines = [",".join(["Time[+09:00]", *cols])]
    for i in range(120):
        ts = dt.datetime(2026, 8, 6, 8) + dt.timedelta(minutes=i)
        cells = [str(100 * u + 10 * c + i % 5) for u in range(1, 5) for c in range(1, 4)] + [str(i % 3), "20.5"]
        cells += ["1" if (u, b) == (2, 3) and (10 <= i < 20 or i == 50) else "0" for u in (1, 2, 9) for b in range(1, 5)]
        lines.append(",".join([ts.strftime("%Y/%m/%d %H:%M"), *cells]))
    return "\n".join(lines) + "\n"


def test_wide_file(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    fixtures.write_text(str(src), "001_PCS監視_2026-08-06.csv", wide_text())
    params = job.JobParams(identity=IdentityParams(entity_from_column=r"^(PCS\d+)_(.+)$"))
    res = job.run(spark, str(src), out, params)
    stored = spark.read.parquet(f"{out}/readings")
    units = stored.where("role = 'unit'").groupBy("entity").agg(F.count("*").alias("n"), F.countDistinct("metric").alias("m"))
    assert sorted(map(tuple, units.collect())) == [(f"PCS{u:02d}", 360, 3) for u in range(1, 5)]
    plant = stored.where("entity = 'PLANT' and role = 'plant'").select("metric").distinct().collect()
    assert sorted(r.metric for r in plant) == ["Opt_21", "Opt_22"]
    alarms = res["alarms"].collect()
    assert [(a.entity, a.bit, a.minutes_on, a.share_pct, a.events) for a in alarms] == [("PCS02", "ANN_203", 11, 9.17, 2)]
    assert str(alarms[0].first_on) == "2026-08-06 08:10:00" and str(alarms[0].last_on) == "2026-08-06 08:50:00"
    # cleaned readings by unit, and the table behind a chart as CSV
    readings = stored.where("role <> 'alarm'")
    sinks.write_by_entity(readings, res["channels"], stored.where("role = 'alarm'"), f"{out}/split")
    assert spark.read.parquet(f"{out}/split/units").where("entity = 'PCS03'").count() == 360
    assert spark.read.parquet(f"{out}/split/plant").count() == 240
    view = sinks.view_csv(res["deviation"], "Data01", ["PCS01", "PCS02"], days=["2026-08-06"], lo="2026-08-06 09:00:00")
    sinks.write_tables({"view": view}, out, "csv")
    back = spark.read.option("header", True).csv(f"{out}/view").orderBy("ts").collect()
    assert len(back) == 60 and back[0].asDict() == {"ts": "2026-08-06 09:00:00", "PCS01": "110.0", "PCS02": "210.0"}


def test_sites_with_headers_of_their_own(spark, tmp_path):
    """The first file is not wide; the second is split into units all the same, and what is there is read by day."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    plain = "time,power,temp\n" + "".join(f"2026-08-06 08:{m:02d}:00,{m * 3 % 17},{20 + m % 4}\n" for m in range(60))
    fixtures.write_text(str(src), "001_a_2026-08-06.csv", plain)
    fixtures.write_text(str(src), "002_b_2026-08-06.csv", wide_text())
    res = job.run(spark, str(src), out, job.JobParams(analysis=AnalysisParams(time_from="2026-08-06 08:00:00", time_to="2026-08-06 08:29:00")))
    stored = spark.read.parquet(f"{out}/readings")
    units = {r.entity: r["count"] for r in stored.where("role = 'unit'").groupBy("entity").count().collect()}
    assert units == {f"PCS{u:02d}": 360 for u in range(1, 5)}
    assert stored.where("entity = 'PCS001'").select("metric").distinct().count() == 2
    scan = sinks.read_by_date(spark, f"{out}/readings", "2026-08-06", "2026-08-07")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in scan
    assert res["values"].agg(F.max("ts")).first()[0] <= dt.datetime(2026, 8, 6, 8, 29)
    assert {r.metric for r in res["kpis"].collect()} == {r.metric for r in res["values"].select("metric").distinct().collect()}
    matrix = res["value_matrix"]
    assert {"PCS01", "PCS02", "PCS03", "PCS04"} <= set(matrix.columns) and matrix.count() == res["values"].select("metric", "ts").distinct().count()
    assert [r.rank for r in res["zeros"].orderBy("rank").collect()] == list(range(1, res["zeros"].count() + 1))
    assert spark.read.parquet(f"{out}/units/units").where("entity = 'PCS02'").count() > 0
    assert res["long"].count() > 0 and res["scope"].where("not dropped").count() > 0
