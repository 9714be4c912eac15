"""Row-order primitives against pandas on random frames, cut into small chunks and with a hot series."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetspark.operators import ordered

T0 = dt.datetime(2024, 1, 1)


def frame(seed, n=400):
    """Three series, one of them most of the rows; repeated values, nulls and empty stretches."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.7 else rng.choice(["a", "b"])
        minute = rng.randint(0, 300) + (2000 if rng.random() < 0.2 else 0)
        value = None if rng.random() < 0.1 else float(rng.choice([1, 1, 1, 2, 3]))
        rows.append((key, T0 + dt.timedelta(minutes=minute), i, value))
    return pd.DataFrame(rows, columns=["k", "ts", "no", "v"])


def to_spark(spark, pdf):
    rows = [(r.k, r.ts.to_pydatetime(), int(r.no), None if pd.isna(r.v) else float(r.v)) for r in pdf.itertuples()]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, no long, v double")


CASES = [(1, "30 minutes"), (2, "1 minute"), (3, "10 days"), (4, "7 minutes")]


@pytest.mark.parametrize("seed,chunk", CASES)
def test_row_number_and_previous(spark, seed, chunk):
    pdf = frame(seed).sort_values(["k", "ts", "no"])
    want_no = pdf.groupby("k").cumcount() + 1
    want_prev = pdf.groupby("k").v.shift(1)
    first = pdf.groupby("k").cumcount() == 0
    df = ordered.with_row_number(to_spark(spark, pdf), ["k"], ["ts", "no"], "row", chunk)
    got = {r.no: r.row for r in df.collect()}
    assert got == dict(zip(pdf.no, want_no))
    df = ordered.with_previous(to_spark(spark, pdf), ["k"], ["ts", "no"], ["v"], "p", chunk)
    got = {r.no: r.p for r in df.collect()}
    for no, prev, is_first in zip(pdf.no, want_prev, first):
        if is_first:
            assert got[no] is None
        else:
            assert (got[no].v is None and pd.isna(prev)) or got[no].v == prev


@pytest.mark.parametrize("seed,chunk", CASES)
def test_runs(spark, seed, chunk):
    pdf = frame(seed).sort_values(["k", "ts", "no"])
    start = pdf.groupby("k").v.transform(lambda s: s != s.shift())
    run = start.groupby(pdf.k).cumsum()
    size = pdf.groupby([pdf.k, run]).no.transform("size")
    df = ordered.with_runs(to_spark(spark, pdf), ["k"], ["ts", "no"], "v", chunk)
    got = {r.no: (r.run_id, r.run_len, r.run_start) for r in df.collect()}
    assert got == {n: (int(a), int(b), bool(c)) for n, a, b, c in zip(pdf.no, run, size, start)}


def test_one_run_over_many_chunks(spark):
    df = spark.range(5000).select(
        F.lit("x").alias("k"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), F.lit(7.0).alias("v"))
    out = ordered.with_runs(df, ["k"], ["ts"], "v", "10 minutes").groupBy("run_id", "run_len").count().collect()
    assert [tuple(r) for r in out] == [(1, 5000, 5000)]


@pytest.mark.parametrize("window", [2, 3, 4, 5, 6])
def test_centred_window(spark, window):
    pdf = frame(9).sort_values(["k", "ts", "no"])
    roll = pdf.groupby("k").v.rolling(window, center=True, min_periods=window)
    want = {n: (a, b) for n, a, b in zip(pdf.no, roll.max().droplevel(0).reindex(pdf.index), roll.mean().droplevel(0).reindex(pdf.index))}
    df = ordered.with_centred_window(to_spark(spark, pdf), ["k"], ["ts", "no"], "v", window, "20 minutes", block_rows=13)
    rows = df.collect()
    assert len(rows) == len(pdf)
    for r in rows:
        top, mean = want[r.no]
        if pd.isna(top):
            assert r.roll_max is None and r.roll_mean is None
        else:
            assert r.roll_max == top and r.roll_mean == pytest.approx(mean)


@pytest.mark.parametrize("chunk", ["5 minutes", "1 day"])
def test_nearest(spark, chunk):
    pdf = frame(5).drop_duplicates(["k", "ts"])
    probes = [(k, T0 + dt.timedelta(minutes=m, seconds=s)) for k in ("hot", "a", "b") for m in range(-10, 2400, 97) for s in (0, 30)]
    out = ordered.nearest(spark.createDataFrame(probes, "k string, ts timestamp_ntz"), to_spark(spark, pdf), ["k"], "v", chunk=chunk)
    got = {(r.k, r.ts): (r.sample_ts, r.v) for r in out.collect()}
    assert len(got) == len(probes)
    for k, ts in probes:
        s = pdf[pdf.k == k].sort_values("ts")
        best = s.iloc[int(np.argmin(np.abs((s.ts - ts).dt.total_seconds().to_numpy())))]
        value = None if pd.isna(best.v) else best.v
        assert got[(k, ts)] == (best.ts.to_pydatetime(), value)


@pytest.mark.parametrize("small", [0, 10**6])
def test_exact_quantiles(spark, small):
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rng.normal(size=5001)] + [("flat", 2.0)] * 300 + [("one", 5.0)] + [("two", 1.0), ("two", 2.0)]
    rows += [("ties", float(x)) for x in rng.integers(0, 4, size=999)] + [("hot", None)]
    qs = [0.0, 0.05, 0.5, 0.95, 1.0]
    out = ordered.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", qs, "q", small_group=small)
    got = {r.k: list(r.q) for r in out.collect()}
    pdf = pd.DataFrame(rows, columns=["k", "v"]).dropna()
    for k, g in pdf.groupby("k"):
        assert got[k] == pytest.approx(list(g.v.quantile(qs)), abs=1e-12)
    assert len(got) == 5


def test_sized(spark):
    df = spark.range(10)
    assert "LocalTableScan" in ordered.sized(df)._jdf.queryExecution().executedPlan().toString()
    assert ordered.sized(df, 9) is df


def test_ranks_are_cut_up_until_buckets_are_small(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=20_000), np.zeros(10_000), rng.exponential(size=20_000)])
    df = spark.createDataFrame(pd.DataFrame({"k": "hot", "v": values}))
    n = len(values)
    ranks = [0, 7, n // 3, n // 2, n - 2, n - 1]
    out = ordered.values_at_ranks(df, ["k"], "v", [F.lit(r) for r in ranks], [0.0, 0.5], small_group=20).first()
    ordered_values = np.sort(values)
    assert out.n == n and out.found == {r: ordered_values[r] for r in ranks}


def test_fit_chunk(spark):
    df = spark.range(1000).select(F.lit("x").alias("k"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"))
    assert ordered.fit_chunk(df, ["k"]) == "30 days"
    assert ordered.fit_chunk(df, ["k"], most_rows=999) == "5 minutes"
    assert ordered.fit_chunk(df, ["k"], most_rows=10) == "10 seconds"


def test_nearest_finds_its_own_stretches(spark):
    """Probes in a cluster far from most samples, a series without samples, one without probes, a null value."""
    day = dt.timedelta(days=1)
    samples = [("a", T0 + i * day, float(i)) for i in range(400)] + [("a", T0 + dt.timedelta(seconds=7), None), ("c", T0, 1.0)]
    probes = [("a", T0 + dt.timedelta(seconds=s)) for s in range(12)] + [("a", T0 + 1000 * day), ("a", T0 - day), ("b", T0)]
    out = ordered.nearest(spark.createDataFrame(probes, "k string, ts timestamp_ntz"), spark.createDataFrame(samples, "k string, ts timestamp_ntz, v double"), ["k"], "v")
    got = {(r.k, r.ts): (r.sample_ts, r.v) for r in out.collect()}
    assert len(got) == len(probes) and got[("b", T0)] == (None, None)
    for s in range(12):
        near = T0 if s < 4 else T0 + dt.timedelta(seconds=7)
        assert got[("a", T0 + dt.timedelta(seconds=s))] == (near, 0.0 if s < 4 else None)
    assert got[("a", T0 + 1000 * day)] == (T0 + 399 * day, 399.0) and got[("a", T0 - day)] == (T0, 0.0)


@pytest.mark.parametrize("rows", [0, 1, 5000])
def test_positions(spark, rows):
    df = spark.range(rows).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("k"), "id").repartition(7)
    out = ordered.with_position(df, [F.col("k").desc(), "id"])
    want = {i: n for n, (_, i) in enumerate(sorted((-r.k, r.id) for r in df.collect()), 1)}
    assert {r.id: r.place for r in out.collect()} == want


def test_hot_keys_stay_where_they_are(spark):
    """Half of the rows zeros, a third nulls: no task of the join gets many of them."""
    n = 60_000
    value = F.when(F.col("id") % 2 == 0, 0.0).when(F.col("id") % 3 == 0, F.lit(None).cast("double")).otherwise((F.col("id") % 5000).cast("double"))
    rows = spark.range(n).select("id", F.lit("s").alias("k"), value.alias("v"))
    known = rows.where("v is not null").groupBy("k", "v").agg(F.count("*").alias("times")).withColumn("twice", F.col("times") > 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = ordered.join_known(rows, known, ["k", "v"], "times", ["id"])
        tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        got = {r.id: r.twice for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(tasks) < n / 4 and sum(tasks) == n
    times = {(r.v): r.times for r in known.collect()}
    for r in rows.collect():
        assert got[r.id] == (None if r.v is None else times[r.v] > 1)
