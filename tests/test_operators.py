"""Edge cases: nulls, ties, constants, one unit, empty input, and brute force where SQL has no say."""

import datetime as dt
import difflib
import json
import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetspark.functions import text as tx
from fleetspark.operators import align, diagnostics, fuzzy, reshape, rules, series, summaries
from fleetspark.operators import dictionary as dic
from fleetspark.params import AnalysisParams, ChartSpec, Rule

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "file string, entity string, metric string, ts timestamp_ntz, value double, row_no long"


def rd(spark, rows, file="f"):
    """(entity, metric, minute, value) as readings; the minute is the row."""
    data = [(file, e, m, T0 + dt.timedelta(minutes=t), None if v is None else float(v), t) for e, m, t, v in rows]
    return spark.createDataFrame(data, SCHEMA)


def series_of(spark, *values):
    return rd(spark, [("u", "m", i, v) for i, v in enumerate(values)])


def hit_rows(spark, values, *rule):
    flags = rules.collect_flags(series_of(spark, *values), None, list(rule))
    return sorted(r.row_no for r in flags.collect())


@pytest.mark.parametrize("values,rule,want", [
    ([0, 0.5, -0.5, None, 1], Rule("zero", tolerance=0.5), [0, 1, 2]),
    ([1, None, 2], Rule("blank", scope="all"), [1]),
    ([1, -1, 0, None], Rule("negative"), [1]),
    ([1, 2, 3], Rule("threshold", operator="=>", value=2), [0]),
    ([1, 2, 3, None], Rule("threshold", operator="!=", value=2), [0, 2]),
    ([1, 2, 3], Rule("between", value=3, value2=2), [1, 2]),
    ([5, 5, 4, 3, None], Rule("top_bottom", rank=1), [0, 1]),
    ([5, 5, 4, 3, 3], Rule("top_bottom", rank=2, bottom=True), [3, 4]),
    ([1, 2], Rule("top_bottom", rank=10), [0, 1]),
    ([1, 2, 3, 4, 5], Rule("top_bottom", rank=50, percent=True), [3, 4]),
    ([1, 2, 3], Rule("top_bottom", rank=1, percent=True), [2]),
    ([7, 7, 7], Rule("outlier_sigma"), []),
    ([0] * 20 + [100], Rule("outlier_sigma", value2=4), [20]),
    ([1, 1, 1, None, None, None, 1, 1], Rule("stuck", value2=3), [0, 1, 2]),
    ([1, 1, 2, 2], Rule("stuck", value2=1), [0, 1, 2, 3]),
    ([1, 9, None, 1, 3], Rule("jump", value2=5), [1]),
    ([1, 9], Rule("jump"), []),
    ([1, None, None, 1, 2], Rule("duplicate"), [0, 3]),
    ([1, 2], Rule("zero", enabled=False, tolerance=9), []),
    ([1, 2], Rule("threshold", operator=">", value=0, scope="pattern", pattern="["), []),
    ([1, 2], Rule("threshold", operator=">", value=0, scope="text"), []),
])
def test_rule(spark, values, rule, want):
    assert hit_rows(spark, values, rule) == want


def test_top_n_beyond_the_direct_limit(spark):
    rng = random.Random(4)
    values = [rng.randint(0, 2000) for _ in range(4000)]
    cut = sorted(values, reverse=True)[1499]
    assert hit_rows(spark, values, Rule("top_bottom", rank=1500)) == [i for i, v in enumerate(values) if v >= cut]


def test_top_hits_move_no_readings(spark):
    rows = spark.range(5000).selectExpr("concat('U', id % 2) AS entity", "cast(id AS double) AS value")
    out = rules.with_top_hit(rows, Rule("top_bottom", rank=5, percent=True, bottom=True), "hit", ["entity"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert out.where("hit").count() == 250


def test_text_rules(spark):
    df = series_of(spark, None, None, None).withColumn("text", F.element_at(F.array(F.lit("Alarm ON"), F.lit(" "), F.lit("ok")), (F.col("row_no") + 1).cast("int")))
    ch = spark.createDataFrame([("m", "Status", False, True)], "metric string, name string, is_numeric boolean, include boolean")
    out = rules.collect_flags(df, ch, [Rule("text_contains", text="alarm", scope="all"), Rule("blank", scope="text"), Rule("zero")])
    assert sorted((r.row_no, r.rule, r.name) for r in out.collect()) == [(0, "text_contains", "Status"), (1, "blank", "Status")]
    capped = rules.collect_flags(df, ch, [Rule("blank", scope="all"), Rule("text_contains", text="o", scope="all")], cap=2)
    assert capped.count() == 2


def test_scope_by_any_name(spark):
    df = spark.createDataFrame([("Data10", "PCS01_Data10", True)], "metric string, raw string, is_numeric boolean")
    for rule, want in ((Rule("zero", scope="selected", columns=("PCS01_Data10",)), True),
                       (Rule("zero", scope="pattern", pattern="^PCS01"), True), (Rule("zero", scope="selected", columns=("x",)), False)):
        assert df.where(rules.in_scope(rule, ["metric", "raw"])).count() == int(want)


def test_constant_scale_and_bands(spark):
    df = series_of(spark, 5, 5, None)
    out = rules.with_scale(df, Rule("color_scale")).orderBy("row_no").collect()
    assert [(r.position, r.band) for r in out] == [(0.0, 0), (0.0, 0), (None, None)]
    assert [r.bar for r in rules.with_data_bar(df).orderBy("row_no").collect()] == [0.0, 0.0, None]
    stops = F.array(*[F.lit(float(x)) for x in (0, 10, 20, 30, 40)])
    values = spark.createDataFrame([(float(v),) for v in (-1, 10, 20, 20.5, 39, 40, 99)], "v double")
    bands = values.select(rules.excel_band(F.col("v"), stops).alias("b"), rules.band_index(F.col("v"), stops, 5).alias("i")).collect()
    assert [r.b for r in bands] == [0, 1, 1, 2, 3, 3, 4]
    assert [r.i for r in bands] == [0, 1, 2, 2, 3, 4, 4]


def test_single_unit_has_no_deviation(spark):
    out = align.deviation(align.aligned(series_of(spark, 1, 2, 3))).collect()
    assert all(r.deviation is None and r.ref is None for r in out) and len(out) == 3


def test_grid_from_the_finest_series(spark):
    rows = [("a", "m", t, t) for t in range(0, 60, 10)] + [("b", "m", t, t) for t in range(0, 60, 5)]
    df = rd(spark, rows).withColumn("ts", F.when(F.col("entity") == "a", F.col("ts") + F.expr("interval 2 minutes")).otherwise(F.col("ts")))
    out = align.aligned(df).groupBy("ts").count().collect()
    assert sorted(r["count"] for r in out) == [1] * 6 + [2] * 6
    few = align.aligned(series_of(spark, 1, 2)).select("ts").collect()
    assert len(few) == 2


def test_empty_input(spark):
    empty = rd(spark, [])
    assert align.deviation(align.aligned(empty)).count() == 0
    assert summaries.daily_summary(empty).count() == 0
    assert summaries.zero_report(empty).count() == 0
    assert rules.collect_flags(empty, None, [Rule("stuck"), Rule("jump", value2=1), Rule("outlier_sigma"), Rule("duplicate")]).count() == 0
    roles = {"ac_power": "ac", "dc_power": "dc", "irradiance": "irr"}
    assert diagnostics.unit_table(empty, roles, AnalysisParams()).count() == 0
    assert diagnostics.availability(empty, roles, AnalysisParams()).count() == 0


def test_daily_summary_without_interval(spark):
    out = summaries.daily_summary(series_of(spark, 4, 0)).first()
    assert (out.samples, out.expected, out.total, out.zero_samples, out.zero_pct) == (2, 2, None, 1, 50.0)


def test_daily_total_kinds(spark):
    ch = spark.createDataFrame([("m", "Energy", "kWh", "１分毎の差分値"), ("p", "Power", "kW", "瞬時値")],
                               "metric string, name string, unit string, kind string")
    rows = [("u", m, t, 6) for t in range(0, 60, 10) for m in ("m", "p")]
    out = {r.metric: (r.total, r.total_note, r.expected) for r in summaries.daily_summary(rd(spark, rows), ch).collect()}
    assert out == {"m": (36.0, "sum of differences", 144), "p": (6.0, "value x interval", 144)}


def test_zero_run_is_broken_by_null(spark):
    r = summaries.zero_report(series_of(spark, 0, 0, None, 0, 5, 0)).first()
    assert (r.zero_samples, r.longest_zero_run, r.valid, r.zero_pct) == (4, 2, 5, 80.0)


def test_unit_table_without_irradiance(spark):
    rows = [(u, m, t, v) for t in range(4) for u, ac, dc in (("a", 90, 100), ("b", 80, 100)) for m, v in (("ac", ac), ("dc", dc))]
    out = {r.entity: r for r in diagnostics.unit_table(rd(spark, rows), {"ac_power": "ac", "dc_power": "dc", "irradiance": "irr"}, AnalysisParams()).collect()}
    assert out["a"].ac_kwh == pytest.approx(6.0) and out["a"].efficiency_pct == pytest.approx(90)
    assert out["b"].efficiency_vs_fleet_pt == -5.0 and out["b"].dc_per_irradiance is None
    assert out["a"].daylight_samples == 4


@pytest.mark.parametrize("ac,dc,eff,want", [
    (-0.9, -9, -9, "OK"), (None, -9, -9, "OK"), (-1.0, -2.0, -0.5, "DC side + inverter"), (-1.5, -2.0, -0.4, "DC side (array"),
    (-1.5, None, -0.5, "Inverter"), (-2.0, -1.9, None, "Unexplained"), (-1.5, -1.9, -0.4, "OK")])
def test_verdict(spark, ac, dc, eff, want):
    row = tuple(None if x is None else float(x) for x in (ac, dc, eff))
    df = spark.createDataFrame([row], "ac_vs_fleet_pct double, dc_vs_fleet_pct double, efficiency_vs_fleet_pt double")
    assert df.select(diagnostics.verdict()).first()[0].startswith(want)


def test_findings_when_all_is_well(spark):
    rows = [(u, m, t, 100) for t in range(4) for u in ("a", "b") for m in ("ac", "dc", "irr")]
    units = diagnostics.unit_table(rd(spark, rows), {"ac_power": "ac", "dc_power": "dc", "irradiance": "irr"}, AnalysisParams())
    out = diagnostics.findings(diagnostics.attribution(units)).collect()
    assert [r.finding for r in out] == ["Every unit tracks the fleet median."]


def test_findings_tell_a_little_below_from_a_little_above(spark):
    rows = [("U1", -3.0, -0.04, -0.0), ("U2", -2.5, 0.04, 0.0)]
    units = spark.createDataFrame(rows, "entity string, ac_vs_fleet_pct double, dc_vs_fleet_pct double, efficiency_vs_fleet_pt double")
    out = [r.finding for r in diagnostics.findings(diagnostics.attribution(units)).orderBy("pos").collect()]
    assert [f"{f.split('DC side ')[1].split(' %')[0]} {f.split('efficiency ')[1].split(' pt')[0]}" for f in out] == ["-0.0 -0.00", "+0.0 +0.00"]
    values = [(f"U{i}", 100.0, 1.0, 1.0, e) for i, e in enumerate((90.0, 89.999, 90.001))]
    fleet = diagnostics.against_fleet(spark.createDataFrame(values, "entity string, ac_kwh double, dc_per_irradiance double, ac_per_irradiance double, efficiency_pct double"))
    assert [str(r[0]) for r in fleet.orderBy("entity").select("efficiency_vs_fleet_pt").collect()] == ["0.0", "-0.0", "0.0"]


def test_findings_query_on_a_fleet_whose_units_are_alike(spark, tmp_path):
    """Every event once for each unit: no unit is bad, of which the SQL says nothing."""
    import __spark_entry__ as entry
    from tests.oracle import rows_of

    day = dt.datetime(2024, 1, 1)
    kinds = ["click", "purchase", "view", "error", "signup"]
    rows = [(i * 100 + u, day + dt.timedelta(hours=6 * (i // 5)), u, kinds[i % 5], 30.0 + i % 7, "{}") for i in range(100) for u in range(10)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    mine = [tuple(r) for r in entry.queries()["findings"](spark, str(tmp_path)).collect()]
    theirs = con.execute(entry.oracle_sql()["findings"]).fetchall()
    assert rows_of(["pos", "finding"], mine) == rows_of(["pos", "finding"], theirs)


def test_stable_mask_is_false_at_the_edges(spark):
    rows = diagnostics.role_rows(rd(spark, [("u", "irr", t, 500 if t != 7 else 900) for t in range(12)]), {"irradiance": "irr"})
    out = diagnostics.stable_mask(rows, 400, 5, 3).orderBy("ts").collect()
    assert [r.stable for r in out] == [False] + [True] * 5 + [False] * 3 + [True] * 2 + [False]


def test_thin_and_chart(spark):
    df = series_of(spark, *range(10))
    out = series.thin(df, ["entity"], ["ts"], 4).orderBy("ts").collect()
    assert [r.value for r in out] == [0, 3, 6, 9] and out[0].step == 3 and out[0].rows_total == 10
    chart = ChartSpec(y_columns=("m",), normalize=True, group_mode="per_entity")
    grouped = series.group_series(series.chart_series(df, chart), chart).orderBy("ts").collect()
    assert grouped[-1].y == 100.0 and grouped[0].chart == "u" and grouped[0].axis_unit == ""
    assert series.chart_series(series_of(spark, 1, None), chart).count() == 0
    zero = series.pct_of_max(series_of(spark, 0, 0), ["entity"]).collect()
    assert [r.value for r in zero] == [0.0, 0.0]


def test_shared_channel_with_missing_rows(spark):
    rows = [("a", "s", 0, 1), ("b", "s", 0, 1.0000001), ("a", "g", 0, 1), ("b", "g", 0, 1), ("a", "g", 1, 1),
            ("a", "n", 0, None), ("b", "n", 0, None), ("PLANT", "p", 0, 3), ("a", "one", 0, 3)]
    values = rd(spark, rows).select("metric", "ts", "entity", "value")
    got = {r.metric: r.shared for r in align.shared_channels(values).collect()}
    assert got == {"s": True, "g": False, "n": False, "p": True, "one": False}


def test_resample_sums_differences_if_asked(spark):
    ch = spark.createDataFrame([("m", True)], "metric string, is_delta boolean")
    df = series_of(spark, 1, 2, 3, None).withColumn("text", F.when(F.col("row_no") == 3, "x"))
    assert [r.value for r in align.resample(df, "2 minutes").orderBy("ts").collect()] == [1.5, 3.0]
    assert [r.value for r in align.resample(df, "2 minutes", ch, "sum").orderBy("ts").collect()] == [3.0, 3.0]
    assert [r.text for r in align.resample(df, "2 minutes").orderBy("ts").collect()] == [None, "x"]


def test_layout_of_bits_and_single_group_patterns(spark):
    names = ["t", "INV1_P", "INV2_P", "INV2", "ANN_101", "ANN_2305", "ANN_99", "site"]
    cols = spark.createDataFrame([("f", i, n) for i, n in enumerate(names)], "file string, pos int, raw string")
    out = {r.raw: r for r in reshape.layout(cols, r"^(INV\d+)", r"^ANN_\d+$", "t", groups=1).collect()}
    assert (out["INV1_P"].entity, out["INV1_P"].metric) == ("INV1", "P") and out["INV2"].metric == "INV2"
    assert out["ANN_101"].alarm_entity == "INV1" and out["ANN_2305"].alarm_entity == "PLANT" and out["ANN_99"].alarm_entity == "PLANT"
    assert out["site"].role == "plant" and out["t"].role == "time"
    assert reshape.wide_files(reshape.layout(cols, r"^(INV\d+)", "", "t", groups=1)).first().is_wide


@pytest.mark.parametrize("cutoff", [0.86, 0.95, 0.7, 0.6, 0.35, 1.0])
def test_fuzzy_join_finds_what_comparing_all_pairs_finds(spark, cutoff):
    rng = random.Random(8)

    def word():
        return "".join(rng.choice("abcd") for _ in range(rng.randint(3, 18)))

    keys = sorted({word() for _ in range(150)})
    heads = sorted({"".join(c for c in k if rng.random() > 0.1) + rng.choice(["", "x", "ab"]) for k in keys} - set(keys) - {""})
    rows = [("f", i, k, k, "", "", "", False) for i, k in enumerate(keys)]
    entries = dic.entries(spark.createDataFrame(
        rows, "file string, ord long, key string, name string, unit string, note string, kind string, shared boolean"))
    _, norm = dic.index(entries)
    asked = spark.createDataFrame([("f", h, h) for h in heads], "file string, raw string, text string")
    got = {r.raw: (r.name, r.ratio) for r in dic.fuzzy_matches(asked, norm, cutoff).select("raw", "entry.name", "ratio").collect()}
    want = {}
    for h in heads:
        best = max(keys, key=lambda k: (difflib.SequenceMatcher(None, h, k).ratio(), -keys.index(k)))
        ratio = difflib.SequenceMatcher(None, h, best).ratio()
        if ratio >= cutoff:
            want[h] = (best, ratio)
    assert got == want and (len(want) > 20 or cutoff > 0.9)


def test_fuzzy_join_of_small_tables_broadcasts_no_pieces(spark, tmp_path):
    """Estimates are those of the tables, of which pieces are a hundredfold: the only broadcast is a flag for each dictionary."""
    spark.range(300).selectExpr("'f' AS file", "'h' || id AS raw", "sha2(cast(id AS string), 256) AS text").write.parquet(f"{tmp_path}/t")
    heads = spark.read.parquet(f"{tmp_path}/t")
    entry = F.struct(F.lit(1).alias("ord"), F.col("raw").alias("name"))
    found = dic.fuzzy_matches(heads, heads.select("file", F.col("text").alias("lookup"), entry.alias("entry")), 0.9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert "SortMergeJoin" in plan and all("LeftOuter" in line for line in joins)
    assert {(r.raw, r.name, r.ratio) for r in found.select("raw", "entry.name", "ratio").collect()} == {(f"h{i}", f"h{i}", 1.0) for i in range(300)}


@pytest.mark.parametrize("cutoff", [0.5, 0.75, 0.86])
def test_fuzzy_join_in_blocks_finds_what_comparing_all_pairs_finds(spark, monkeypatch, cutoff):
    """Large dictionaries cut into blocks, small ones that share one, texts that meet by pieces of all sizes, and the same text in several files."""
    monkeypatch.setattr(fuzzy, "INDEXED", 1500)
    monkeypatch.setattr(fuzzy, "STREAMED", 2500)
    monkeypatch.setattr(fuzzy, "PAIRS", 50)
    rng = random.Random(11)
    letters = "abcdefghij号\U0001f600"

    def bent(text):
        out = [c for c in text if rng.random() > 0.12]
        for _ in range(rng.randint(0, 1 + len(text) // 5)):
            out.insert(rng.randint(0, len(out)), rng.choice(letters))
        return "".join(out)

    entries, heads = [], []
    for f, count in (("large", 150), *((f"small{i}", 6) for i in range(18)), ("empty", 0)):
        keys = {"".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 4, 7, 9, 12, 30, 45]))) for _ in range(count)} | ({"same text"} if count else set())
        entries += [(f, i, k) for i, k in enumerate(sorted(keys))]
        heads += [(f, h) for h in sorted({bent(k) for k in keys} | {"same text", "", "abc"})]
    norm = spark.createDataFrame(entries, "file string, ord long, lookup string").select("file", "lookup", F.struct("ord", F.col("lookup").alias("name")).alias("entry"))
    asked = spark.createDataFrame([(f, h, h) for f, h in heads] + [("large", "null", None)], "file string, raw string, text string")
    got = {(r.file, r.raw): (r.name, r.ratio) for r in dic.fuzzy_matches(asked, norm, cutoff).select("file", "raw", "entry.name", "ratio").collect()}
    want = {}
    for f, h in heads:
        rated = [(difflib.SequenceMatcher(None, h, k).ratio(), -o, k) for g, o, k in entries if g == f]
        if h and rated and max(rated)[0] >= cutoff:
            want[f, h] = (max(rated)[2], max(rated)[0])
    assert got == want and len(want) > 80


def test_pieces_of_a_block_find_every_pair_that_may_reach_the_cutoff():
    """Characters that match as far apart as the cutoff allows share a piece, whatever stands between them."""
    rng = np.random.default_rng(5)
    xs, ys = [], []
    for _ in range(400):
        a, b = rng.integers(8, 40, 2)
        match = -(-3 * (a + b) // 8)
        if match > min(a, b):
            continue
        core = rng.integers(0x4E00, 0x9000, match)
        for out, n, other in ((xs, a, 0xAC00), (ys, b, 0xB000)):
            at = np.zeros(n, bool)
            at[rng.choice(n, match, replace=False)] = True
            text = rng.integers(other, other + 1000, n)
            text[at] = core
            out.append("".join(map(chr, text)))
    known, asked = (fuzzy.Texts(np.zeros(len(t), np.int64), pa.array(t), 0.75) for t in (ys, xs))
    pairs = {p for x, y in fuzzy.Block(known, 0.75).partners(asked) for p in zip(x.tolist(), y.tolist())}
    assert len(xs) > 200 and {(i, i) for i in range(len(xs))} <= pairs and len(pairs) < 1.1 * len(xs)


SENT = """
import sys
from pyspark.sql import SparkSession, functions as F
from fleetspark.operators import dictionary as dic
at = sys.argv[1]
spark = SparkSession.builder.config(map={
    "spark.master": "local[4]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": at + "/shared", "spark.sql.warehouse.dir": at + "/wh",
    "spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://" + at + "/events", "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false"}).getOrCreate()
code = F.decode(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)), "ISO-8859-1")
keys = spark.range(4000).select(F.lit("f").alias("file"), F.col("id").alias("ord"), code.alias("lookup"))
heads = keys.select("file", F.col("ord").cast("string").alias("raw"), F.concat(F.lit("号号"), "lookup").alias("text"))
print(dic.fuzzy_matches(heads, keys.select("file", "lookup", F.struct("ord").alias("entry")), 0.75).where("raw = entry.ord").count())
spark.stop()
"""


def test_fuzzy_join_sends_little_more_than_the_texts(tmp_path):
    """8000 texts of some 50 bytes: a piece of them is not a row, so shuffles hold a few copies of each, not a hundred."""
    (tmp_path / "events").mkdir()
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", SENT, str(tmp_path)], env=os.environ | {"PYTHONPATH": repo}, cwd=repo, capture_output=True, text=True, timeout=600)
    assert run.stdout.split()[-1:] == ["4000"], run.stderr[-2000:]
    ended = [json.loads(line) for f in (tmp_path / "events").iterdir() for line in f.open() if "SparkListenerTaskEnd" in line]
    sent = sum(e["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"] for e in ended)
    assert 8000 * 50 < sent < 8000 * 50 * 10


def test_substring_join_finds_what_comparing_all_pairs_finds(spark):
    rng = random.Random(9)
    keys = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))) for _ in range(60)})
    heads = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(120)})
    rows = [("f", i, k, k, "", "", "", False) for i, k in enumerate(keys)]
    entries = dic.entries(spark.createDataFrame(
        rows, "file string, ord long, key string, name string, unit string, note string, kind string, shared boolean"))
    _, norm = dic.index(entries)
    asked = spark.createDataFrame([("f", h, h) for h in heads], "file string, raw string, base string")
    got = {r.raw: r.name for r in dic.substring_matches(asked, norm).select("raw", "entry.name").collect()}
    want = {h: next(k for k in keys if len(k) >= 4 and (k in h or h in k)) for h in heads
            if any(len(k) >= 4 and (k in h or h in k) for k in keys)}
    assert got == want


@pytest.mark.parametrize("cell,want", [
    ("1,234.5", 1234.5), ("１２．５", 12.5), ("-", None), ("", None), (" 7 ", 7.0), ("1e3", 1000.0), ("1.5d", None), ("NaN", None),
    ("+.5", 0.5), ("Infinity", None), ("N/A", None), ("－３", -3.0), (None, None), ("12kW", None)])
def test_to_number(spark, cell, want):
    assert spark.createDataFrame([(cell,)], "c string").select(tx.to_number("c")).first()[0] == want


@pytest.mark.parametrize("cell,want", [
    ("2026/8/6 1:02", dt.datetime(2026, 8, 6, 1, 2)), ("2026年8月6日", dt.datetime(2026, 8, 6)),
    ("2026年8月6日 1時2分3秒", dt.datetime(2026, 8, 6, 1, 2, 3)), ("2026-08-06T01:02:03.25", dt.datetime(2026, 8, 6, 1, 2, 3, 250000)),
    ("20260806", dt.datetime(2026, 8, 6)), ("2026-13-01", None), ("soon", None), ("12:30", None), (None, None),
    ("２０２６／０８／０６　０１：０２", dt.datetime(2026, 8, 6, 1, 2)), ("2026-02-30 00:00", None),
    ("2026-08-06 01:02:03.1234567", dt.datetime(2026, 8, 6, 1, 2, 3, 123456))])
def test_parse_timestamp(spark, cell, want):
    assert spark.createDataFrame([(cell,)], "c string").select(tx.parse_timestamp("c")).first()[0] == want


@pytest.mark.parametrize("text,name,unit", [
    ("直流電圧(V)", "直流電圧", "V"), ("Time[+09:00]", "Time[+09:00]", ""), ("a（kW）", "a", "kW"), ("a ( - )", "a ( - )", ""),
    ("plain", "plain", ""), ("x[]", "x[]", ""), (None, "", "")])
def test_split_unit(spark, text, name, unit):
    r = spark.createDataFrame([(text,)], "c string").select(tx.split_unit("c").alias("s")).first().s
    assert (r.name, r.unit) == (name, unit)


def test_normalize_and_units(spark):
    cells = ["［AC］ power・(kW)", "ＡＢ＿ｃ-1", "℃", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in df.select(tx.normalize("c")).collect()] == ["acpowerkw", "abc1", "°c", ""]
    units = [("kWh", True), ("℃", True), ("-", False), ("時間", True), ("温度", False), ("a very long unit", False), ("W/m2", True)]
    got = spark.createDataFrame([(u,) for u, _ in units], "c string").select(tx.looks_like_unit("c")).collect()
    assert [r[0] for r in got] == [w for _, w in units]


def test_strip_entity(spark):
    rows = [("PCS01 ①直流電力", "PCS01"), ("pcs01：AC", "PCS01"), ("PCS01", "PCS01"), ("x", "")]
    got = spark.createDataFrame(rows, "n string, e string").select(tx.strip_entity("n", "e")).collect()
    assert [r[0] for r in got] == ["①直流電力", "AC", "PCS01", "x"]
