"""Reading messy exports: planted faults and odd formats."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetspark.functions import text as tx
from fleetspark.operators import dictionary as dic
from fleetspark.operators import rules, summaries
from fleetspark.params import IdentityParams, ReaderParams, Rule
from fleetspark.plans.catalog import QUERIES
from fleetspark.sources import files as fl
from fleetspark.sources import ingest as ing
from fleetspark.sources.lines import read_lines
from fleetspark.sources.records import ends_open
from tests import fixtures


@pytest.fixture(scope="module")
def units(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("units"))
    fixtures.write_units(folder)
    out = ing.ingest_files(spark, [folder])
    out.readings.persist()
    return out


def test_files_and_columns(units):
    files = units.files.orderBy("file").collect()
    assert len(files) == 6
    f = files[0]
    assert (f.entity, str(f.day), f.n_rows, f.encoding, f.delimiter) == ("PCS001", "2026-08-06", 1380, "cp932", ",")
    assert (f.n_cols, f.n_numeric, f.n_text, f.time_column, f.header_row) == (7, 5, 1, "計測日時", 2)
    assert f.notes == ["unit row detected below the header"]
    cols = units.columns.where(F.col("file") == f.file).orderBy("idx").collect()
    assert [c.raw for c in cols] == fixtures.HEADER
    assert [c.unit_row for c in cols] == [None, "kW", "kW", "-", "℃", "W/m2", None]


def test_every_cell_is_a_row(units):
    n = units.readings.groupBy("entity").count().collect()
    assert {r.entity: r["count"] for r in n} == {"PCS001": 2 * 1380 * 6, "PCS002": 2 * 1440 * 6, "PCS003": 2 * 1440 * 6}
    pf = units.readings.where("metric = 'PF' and value is null").groupBy("file").count().collect()
    assert [r["count"] for r in pf] == [3] * 6


def test_planted_stuck_sensor(spark, units):
    out = rules.collect_flags(units.readings.where("metric = 'TEMP_INV'"), None, [Rule("stuck", value2=100)])
    hits = out.groupBy("file", "entity").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    rows = {r.a.date(): r for r in hits.collect() if r.entity == "PCS002"}
    day = rows[dt.date(2026, 8, 6)]
    assert day.n == 121
    assert (day.a, day.b) == (dt.datetime(2026, 8, 6, 6, 40), dt.datetime(2026, 8, 6, 8, 40))


def test_planted_gap(units):
    report = summaries.quality_report(units.readings, units.files).collect()
    assert {(r.entity, r.gaps) for r in report} == {("PCS001", 1), ("PCS002", 0), ("PCS003", 0)}
    assert {r.interval_us for r in report} == {60_000_000}
    assert {r.rows for r in report} == {1380, 1440}


def one(spark, tmp_path, name, text, encoding="utf-8", reader=ReaderParams(), identity=IdentityParams()):
    fixtures.write_text(str(tmp_path), name, text, encoding)
    return ing.ingest_files(spark, [str(tmp_path)], reader, identity)


def rows_of(out, *cols):
    return sorted(tuple(r) for r in out.readings.select(*cols).collect())


BODY = [("2024/1/5 0:00", "1.5", "起動"), ("2024/1/5 0:10", "-2", "停止"), ("2024/1/5 0:20", "", "x")]
T = [dt.datetime(2024, 1, 5, 0, m) for m in (0, 10, 20)]


@pytest.mark.parametrize("encoding,found,delimiter", [
    ("utf-8", "utf-8-sig", ";"), ("utf-8-sig", "utf-8-sig", ","), ("cp932", "cp932", "\t"), ("utf-16", "utf-16", "\t")])
def test_encodings_and_delimiters(spark, tmp_path, encoding, found, delimiter):
    text = "\r\n".join(delimiter.join(r) for r in [("日時", "電力", "状態")] + BODY) + "\r\n"
    out = one(spark, tmp_path, "7_x.csv", text, encoding)
    f = out.files.first()
    assert (f.encoding, f.delimiter, f.n_rows, f.entity) == (found, delimiter, 3, "PCS7")
    assert rows_of(out, "ts", "metric", "value", "text") == sorted([
        (T[0], "電力", 1.5, None), (T[1], "電力", -2.0, None), (T[2], "電力", None, None),
        (T[0], "状態", None, "起動"), (T[1], "状態", None, "停止"), (T[2], "状態", None, "x")], key=lambda r: (r[0], r[1]))


def test_quotes_thousands_full_width_and_ragged_rows(spark, tmp_path):
    text = ('time,a,"b, c",d\n2024-01-05 00:00:00,"1,234.5",１２．５,1\n2024-01-05 00:01:00,"2,000",***,2,9\n'
            '2024-01-05 00:02:00,3\n\n,,,\n"2024-01-05 00:03:00","say ""hi""",4,－5\n')
    out = one(spark, tmp_path, "plant_2024-02-03.csv", text)
    a = {(r.ts.minute, r.metric): (r.value, r.text) for r in out.readings.collect()}
    # "***" is a filled cell that is no number: 3 of 4 are less than 80 %
    assert a[(0, "b, c")] == (None, "１２．５")
    assert a[(0, "a")][1] == "1,234.5" and a[(3, "a")][1] == 'say "hi"'
    assert a[(1, "d#1")] == (9.0, None) and a[(0, "d#1")] == (None, None)
    assert a[(3, "d")] == (-5.0, None) and a[(2, "d")] == (None, None)
    f = out.files.first()
    assert (f.entity, str(f.day), f.n_rows) == ("plant_2024-02-03", "2024-02-03", 4)


def test_multi_row_header_blank_names_and_empty_column(spark, tmp_path):
    text = ("date,PCS,,note,\n,出力計測値の一覧表です,温度計測値の一覧表です,,空欄の列ですが名前がある\n"
            "2024-01-05 00:00,1,2,x,\n2024-01-05 00:01,3,4,5,\n2024-01-05 00:02,3,4,6,\n")
    out = one(spark, tmp_path, "a.csv", text)
    cols = {c.idx: c for c in out.columns.collect()}
    assert [cols[i].raw for i in range(4)] == ["date", "PCS 出力計測値の一覧表です", "PCS 温度計測値の一覧表です", "note"]
    f = out.files.first()
    assert "multi-row header combined" in f.notes and "dropped 1 empty column(s)" in f.notes
    # two of three notes are numbers, which is less than 80 %
    assert (f.n_numeric, f.n_text) == (2, 1)


def test_date_and_clock_columns_are_merged(spark, tmp_path):
    text = "日付,時刻,v\n" + "".join(f"2024/01/05,{h}:30,{h}\n" for h in range(5))
    out = one(spark, tmp_path, "b.csv", text)
    got = sorted((r.ts, r.value) for r in out.readings.where("metric = 'v'").collect())
    assert got == [(dt.datetime(2024, 1, 5, h, 30), float(h)) for h in range(5)]
    assert "merged time-of-day column '時刻' into the timestamp" in out.files.first().notes


def test_no_header_no_time_and_poor_time(spark, tmp_path):
    fixtures.write_text(str(tmp_path), "1.csv", "1,2\n3,4\n5,6\n")
    fixtures.write_text(str(tmp_path), "2.csv", "time,v\nsoon,1\nlater,2\n2024-01-05 00:00,3\n2024-01-05 00:01,4\nx,5\n")
    fixtures.write_text(str(tmp_path), "3.csv", "")
    listing = fl.discover(spark, str(tmp_path))
    out = ing.ingest_files(spark, [str(tmp_path)], listing=listing)
    files = {r.file[-5:]: r for r in out.files.collect()}
    # data in the first row: it names the columns and is data as well
    assert files["1.csv"].n_rows == 3 and files["1.csv"].time_column is None
    assert files["3.csv"].error is not None and files["1.csv"].error is None
    first = sorted((r.metric, r.value) for r in out.readings.where("file like '%1.csv'").collect())
    assert first == [("1", 1.0), ("1", 3.0), ("1", 5.0), ("2", 2.0), ("2", 4.0), ("2", 6.0)]


def test_explicit_options(spark, tmp_path):
    text = "junk;1;2\nunit;when;power\nA;2024-01-05 00:00;1,5\nB;2024-01-05 00:01;-9999\n"
    reader = ReaderParams(skip_rows=1, header_row=0, thousands="", na_values=("-9999",))
    identity = IdentityParams(time_column="when", entity_column="unit", entity_label="")
    out = one(spark, tmp_path, "x9.csv", text.replace("1,5", "1.5"), reader=reader, identity=identity)
    assert out.files.first().entity == "A"
    got = sorted((r.ts.minute, r.value, r.text) for r in out.readings.where("metric = 'power'").collect())
    # half of the cells are numbers, so the column stays text
    assert got == [(0, None, "1.5"), (1, None, "-9999")]


def test_files_beside_the_data(spark, tmp_path):
    for name in ("b10.csv", "b2.CSV", "a.txt", "~$a.csv", "a.csv", "a_cleaned.csv", "items_dict.csv", "skip.bin"):
        fixtures.write_text(str(tmp_path), name, "x")
    listing = fl.discover(spark, str(tmp_path))
    assert [r.name for r in listing.orderBy("pos").collect()] == [
        "a.csv", "a_cleaned.csv", "b10.csv", "items_dict.csv", "b2.CSV", "a.txt"]
    path = fl.find_dictionary(listing).first().path
    assert path.endswith("items_dict.csv")
    out = {r.name: r.skip_reason for r in fl.eligible(listing, path, limit=2).collect()}
    assert out == {"a.csv": None, "a_cleaned.csv": "previous output", "b10.csv": None, "b2.CSV": "beyond the limit",
                   "items_dict.csv": "this is the dictionary", "a.txt": "same data as a.csv"}
    assert [r.name for r in fl.natural_order(listing).collect()][:4] == [
        "a.csv", "a.txt", "a_cleaned.csv", "b2.CSV"]


DICTIONARY = ("項目表,,,,,,\n,,,,,,\nCSV名称,項目名称,単位,備考,CSV名称,項目名称,単位\n"
              "DC_KW,①直流電力,kW,,RX1,受電電力,kW\nAC_KW,①交流電力,-,,RX2,受電電圧 (V),なし\nIRR,日射量,W/m2,全号機 共通,,,\n")


def test_dictionary_file(spark, tmp_path):
    path = fixtures.write_text(str(tmp_path), "CSV項目名称.csv", DICTIONARY, "cp932")
    cells = ing.dictionary_cells(spark, read_lines(spark, path))
    rows = dic.entries(dic.extract_entries(cells)).orderBy("ord").collect()
    assert [(r.key, r.name, r.unit, r.shared) for r in rows] == [
        ("DC_KW", "①直流電力", "kW", False), ("AC_KW", "①交流電力", "", False), ("IRR", "日射量", "W/m2", True),
        ("RX1", "受電電力", "kW", False), ("RX2", "受電電圧", "V", False)]


def test_translate_steps(spark, tmp_path):
    path = fixtures.write_text(str(tmp_path), "d.csv", DICTIONARY)
    entries = dic.entries(dic.extract_entries(ing.dictionary_cells(spark, read_lines(spark, path))))
    entries = entries.withColumn("file", F.lit("d"))
    heads = ["IRR", "irr", "[AC KW]", "DC_KW(W)", "PCS03_DC_KW", "DCXKWZ", "受電電流(A)", "日射量"]
    asked = spark.createDataFrame([("d", i, h) for i, h in enumerate(heads)], "file string, pos int, raw string")
    got = {r.raw: (r.name, r.unit, r.how) for r in dic.translate(asked, entries).collect()}
    assert got["IRR"] == ("日射量", "W/m2", "exact")
    assert got["irr"] == ("日射量", "W/m2", "normalised")
    assert got["[AC KW]"] == ("①交流電力", "", "normalised")
    assert got["DC_KW(W)"] == ("①直流電力", "kW", "without unit")
    assert got["PCS03_DC_KW"] == ("①直流電力", "kW", "substring")
    assert got["受電電流(A)"] == ("受電電流", "A", None)
    assert got["日射量"][2] == "normalised"


def test_names_with_blanks_and_signs(spark, tmp_path):
    body = "time,power\n" + "".join(f"2024-01-05 00:{m:02d}:00,{m}\n" for m in range(50))
    for name in ("2 z.csv", "a+b%20c.csv", "日本.csv"):
        (tmp_path / name).write_text(body)
    listing = fl.discover(spark, str(tmp_path))
    out = ing.ingest_files(spark, [str(tmp_path)], listing=listing)
    files = out.files.collect()
    assert sorted(f.file.rsplit("/", 1)[-1] for f in files) == ["2 z.csv", "a+b%20c.csv", "日本.csv"]
    assert all(f.error is None and f.n_rows == 50 for f in files)
    assert {r.entity for r in out.readings.select("entity").distinct().collect()} == {"PCS2", "a+b%20c", "日本"}


def test_one_file_whose_text_tells_late(spark, tmp_path):
    rows = [f"2024-01-05 {m // 60:02d}:{m % 60:02d}:00,{m},ok" for m in range(1200)] + ["2024-01-05 23:00:00,1,停止中"] * 5
    (tmp_path / "late.csv").write_bytes(("time,power,status\n" + "\n".join(rows)).encode("cp932"))
    out = ing.ingest_files(spark, [str(tmp_path)])
    assert out.files.first().encoding == "cp932"
    assert out.readings.where("metric = 'status' and text = '停止中'").count() == 5


@pytest.mark.parametrize("name", ["ingest_readings", "ingest_empty_columns"])
def test_lines_of_queries_are_made_once(spark, monkeypatch, name):
    seen = []

    def ingest(spark, lines, *args):
        seen.append(lines._jdf.queryExecution().optimizedPlan().toString())
        return real(spark, lines, *args)

    real = ing.ingest
    monkeypatch.setattr(ing, "ingest", ingest)
    QUERIES[name](spark, "/root/testdata/sf0.001")
    # what reading goes over several times holds no work but a scan
    assert len(seen) == 1 and not any(work in seen[0] for work in ("Union", "Repartition", "Join", "Aggregate"))


def test_whole_times_are_read_as_all_others(spark):
    cells = ["2024-01-05 01:02:03", "2024/1/5 1:2:3.5", "2024年1月5日 01:02:03.123456", "2024-02-30 00:00:00", "2024-01-01T24:00:00", "2024-01-01 00:60:00",
             "0000-01-01 00:00:00", "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999", "２０２４／０１／０５　０１：０２：０３", "2024-01-01 10:00:00Z", "2024-01-01 10:00:00 PM",
             "2024-1-1  1:1:1", " 2024-1-1 1:1:1: ", "2024-01-01 01:01", "2024-01-01 01:01:01.1234567", "2024-13-01 00:00:00", "20240101", "x", "", "2024-01-01 00:00:00\n", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    s = F.rtrim(F.ltrim(F.replace(F.translate(tx.fold_width("c"), "年月日時分/T秒", "-- ::- "), F.lit("  "), F.lit(" "))), F.lit(": "))
    got = df.select(tx.parse_timestamp("c").cast("string").alias("a"), tx._other_timestamp(s).cast("string").alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]
    assert sum(r["a"] is not None for r in got) > 10


def test_quotes_are_looked_for_where_cells_begin(spark):
    lines = ['a,"b', 'a,"b",c', '"a', '"a""', 'a"b', 'a;"b', 'a,b"', '",', '"",""",', '"a"x,"', 'a, "b', '""', '"a,""b"",', 'a,"b""', ""]
    df = spark.createDataFrame([(x,) for x in lines], "raw string")

    def plain(raw, d):
        opened, start, i = False, True, 0
        while i < len(raw):
            if opened and raw[i:i + 2] == '""':
                i += 1
            elif opened and raw[i] == '"':
                opened = False
            elif not opened and start and raw[i] == '"':
                opened = True
            start = raw[i] == d and not opened
            i += 1
        return opened

    for d in ",;":
        got = [r[0] for r in df.select(ends_open(F.col("raw"), d)).collect()]
        assert got == [plain(x, d) for x in lines], d
