"""Cells over several lines, UTF-16 in splits, late data, files that cannot be read."""

import csv
import datetime as dt
import gzip
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from fleetspark.params import ReaderParams
from fleetspark.sources import ingest as ing
from fleetspark.sources import records
from fleetspark.sources.lines import read_lines


@pytest.fixture
def small_splits(spark):
    """Splits of some hundred bytes, so that small files have many."""
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "64"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def cells_of(spark, paths, delimiter=",", longest=records.MAX_RECORD):
    lines = read_lines(spark, paths).withColumn("delimiter", F.lit(delimiter))
    assert lines.select("file", "block").distinct().count() > 5
    rows = records.quoted_records(lines, [",", "\t", ";"], longest).where("raw <> ''")
    cells = ing.split_cells(F.decode(F.encode("raw", "ISO-8859-1"), "UTF-8"), F.col("delimiter"), [",", "\t", ";"])
    out = {}
    for r in rows.select("file", "block", "seq", cells.alias("cells")).orderBy("block", "seq").collect():
        out.setdefault(os.path.basename(r["file"]), []).append(r["cells"])
    return out


def plain(text, delimiter=","):
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
    return [[c.strip(ing.BLANKS + "\n") or None for c in (c.replace("\r\n", "\n") for c in r)] for r in rows if r]


@pytest.mark.parametrize("seed", range(4))
def test_quoted_line_breaks(spark, tmp_path, small_splits, seed):
    """Equal to a plain parser, whatever the split; a quote inside a bare cell opens nothing."""
    rng = random.Random(seed)
    delimiter = rng.choice([",", ";"])
    texts = {}
    for n in range(3):
        out = io.StringIO()
        for i in range(rng.randint(100, 250)):
            cells = ["".join(rng.choices(["a", "é", '"', delimiter, "\n", "\r\n", " ", "日", "\n\n"], [6, 1, 1, 1, .4, .2, 1, 1, .2], k=rng.randint(0, 9))) for _ in range(4)]
            shown = [c if rng.random() < 0.5 and not any(x in c for x in (delimiter, "\n", "\r")) and not c.startswith('"') else '"' + c.replace('"', '""') + '"' for c in cells]
            out.write(delimiter.join([str(i), *shown]) + rng.choice(["\n", "\r\n"]))
        texts[f"{n}.csv"] = out.getvalue()
        (tmp_path / f"{n}.csv").write_bytes(texts[f"{n}.csv"].encode())
    got = cells_of(spark, str(tmp_path), delimiter)
    for name, text in texts.items():
        want = plain(text, delimiter)
        assert [[c and c.strip(ing.BLANKS + "\n") or None for c in r] for r in got[name]] == want


def test_cells_that_do_not_end(spark, tmp_path, small_splits):
    """A quote that nothing closes, or only after too much, leaves lines as rows."""
    rows = [f"{i},x{i}" for i in range(400)]
    (tmp_path / "a.csv").write_text("\n".join([*rows[:200], '200,"open', *rows[201:]]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([*rows[:50], '50,"long', *rows[51:300], '300,end"', *rows[301:380], '380,"a\nb"', *rows[381:]]) + "\n")
    got = cells_of(spark, str(tmp_path), longest=1000)
    assert len(got["a.csv"]) == 400 and len(got["b.csv"]) == 400
    assert got["a.csv"][-1] == ["399", "x399"] and got["b.csv"][380] == ["380", "a\nb"]


@pytest.mark.parametrize("codec,mark", [("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff")])
def test_utf16_in_splits(spark, tmp_path, small_splits, codec, mark):
    """Characters with a byte 0x0A in either half, and zero bytes beside them, end no line."""
    rng = random.Random(7)
    letters = ["a", "7", "Ċ", "ਊ", "Ā", "਀", "日", "🦙", " ", ","]
    lines = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(500)]
    for name, end in (("a.txt", "\n"), ("b.txt", "\r\n")):
        (tmp_path / name).write_bytes(mark + end.join(lines).encode(codec) + ("" if name == "a.txt" else end).encode(codec))
    pieces = read_lines(spark, str(tmp_path), breaks="\n")
    assert pieces.select("file", "block").distinct().count() > 10
    out = records.utf16_lines(pieces)
    for name in ("a.txt", "b.txt"):
        got = [bytes(r["raw"], "latin-1").decode() for r in out.where(F.col("file").endswith(name)).orderBy("block", "seq").collect()]
        while len(got) > len(lines) and not got[-1]:
            got.pop()
        assert got == lines or got == lines[:len(got)] and not any(lines[len(got):])


def test_utf16_file_is_read(spark, tmp_path, small_splits):
    rows = [("日時", "電力", "状態")] + [(f"2024/1/5 {i // 60}:{i % 60:02d}", str(i), "Ċ停止" if i % 2 else "運転") for i in range(300)]
    (tmp_path / "7_x.csv").write_bytes("\r\n".join("\t".join(r) for r in rows).encode("utf-16"))
    out = ing.ingest_files(spark, [str(tmp_path)])
    assert (out.files.first().encoding, out.files.first().n_rows) == ("utf-16", 300)
    assert {(r.ts, r.text) for r in out.readings.where("metric = '状態'").collect()} == {
        (dt.datetime(2024, 1, 5, i // 60, i % 60), "Ċ停止" if i % 2 else "運転") for i in range(300)}


def test_line_breaks_reach_readings(spark, tmp_path):
    text = 'time,power,note\n' + "".join(f'2024-01-05 00:{m:02d}:00,{m},"first {m}\nsecond, {m}"\n' for m in range(30))
    (tmp_path / "u.csv").write_text(text)
    out = ing.ingest_files(spark, [str(tmp_path)])
    got = {r.ts.minute: r.text for r in out.readings.where("metric = 'note'").collect()}
    assert got == {m: f"first {m}\nsecond, {m}" for m in range(30)}
    assert out.files.first().n_rows == 30


def test_data_far_below(spark, tmp_path):
    """Data that begin behind thousands of notes; a file without any."""
    rows = "".join(f"2024-01-05 00:{m:02d}:00,{m},{m * 2}\n" for m in range(40))
    (tmp_path / "far.csv").write_text("".join(f"note {i}\n" for i in range(5000)) + "1,2\ntext between\n" + "time,a,b\n" + rows)
    (tmp_path / "near.csv").write_text("time,a,b\n" + rows)
    (tmp_path / "none.csv").write_text("".join(f"only words {i}\n" for i in range(900)))
    out = ing.ingest_files(spark, [str(tmp_path)])
    files = {os.path.basename(f.file): f for f in out.files.collect()}
    assert (files["far.csv"].header_row, files["far.csv"].n_rows) == (5002, 40)
    assert (files["near.csv"].header_row, files["near.csv"].n_rows) == (0, 40)
    far = out.readings.where(F.col("file").endswith("far.csv")).collect()
    assert {(r.metric, r.value) for r in far} == {("a", float(m)) for m in range(40)} | {("b", float(m * 2)) for m in range(40)}


def test_all_rows_tell_the_time(spark, tmp_path):
    """A column that looks like times at first only is not the time."""
    rows = "".join(f"{'2024-01-05 00:00:00' if m < 300 else m},{m},2024-02-01 {m // 60:02d}:{m % 60:02d}:00\n" for m in range(1200))
    (tmp_path / "x.csv").write_text("first,n,second\n" + rows)
    out = ing.ingest_files(spark, [str(tmp_path)], ReaderParams())
    f = out.files.first()
    assert f.time_column == "second" and f.n_rows == 1200
    assert out.readings.where("metric = 'n'").agg(F.min("ts")).first()[0] == dt.datetime(2024, 2, 1)


def test_files_that_cannot_be_read(spark, tmp_path):
    """One broken file among good ones: an error row, and all of the others' readings."""
    body = "time,power\n" + "".join(f"2024-01-05 {m // 60:02d}:{m % 60:02d}:00,{m * 37 % 101}.{m}\n" for m in range(1400))
    (tmp_path / "good.csv").write_text(body)
    (tmp_path / "whole.csv.gz").write_bytes(gzip.compress(body.encode()))
    packed = gzip.compress(body.encode())
    (tmp_path / "cut.csv.gz").write_bytes(packed[:len(packed) // 2] + packed[-8:])
    (tmp_path / "noise.csv.gz").write_bytes(b"no gzip at all" * 20)
    (tmp_path / "empty.csv").write_bytes(b"")
    out = ing.ingest_files(spark, [str(tmp_path)])
    files = {os.path.basename(f.file): f for f in out.files.collect()}
    assert {n for n, f in files.items() if f.error is None} == {"good.csv", "whole.csv.gz"}
    assert "bytes could be read" in files["cut.csv.gz"].error and files["noise.csv.gz"].error
    counts = {os.path.basename(r["file"]): r["count"] for r in out.readings.groupBy("file").count().collect()}
    assert counts == {"good.csv": 1400, "whole.csv.gz": 1400}


def test_file_that_goes_away(spark, tmp_path):
    """A file that is gone when it is read has an error row."""
    body = "time,power\n" + "".join(f"2024-01-05 00:{m:02d}:00,{m}\n" for m in range(50))
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text(body)
    listing = spark.createDataFrame([(f"file:{tmp_path}/{n}", len(body)) for n in ("a.csv", "b.csv", "c.csv")], "path string, length bigint")
    out = ing.ingest_files(spark, [str(tmp_path)], listing=listing)
    files = {os.path.basename(f.file): f.error for f in out.files.collect()}
    assert files["a.csv"] is None and files["b.csv"] is None and files["c.csv"]
    assert out.readings.count() == 100
