"""CSV scan (S1, S3) and typed-source stringify."""

import datetime

import pytest
from pyspark.sql import functions as F

from tally.operators.normalize import stringify
from tally.sources.files import read_header, scan_csv_strings, with_file_order, write_table

CSV = 'id,name,amt\n1,a\n2,b,5,extra\n3,"x\ny",""\n4,"q""z",1\n'


def _write(tmp_path, text, bom=False):
    p = tmp_path / ("bom.csv" if bom else "plain.csv")
    p.write_bytes((b"\xef\xbb\xbf" if bom else b"") + text.encode("utf-8"))
    return str(p)


def test_edge_csv(spark, tmp_path):
    for bom in (False, True):
        path = _write(tmp_path, CSV, bom)
        df = scan_csv_strings(spark, path)
        assert df.columns == ["id", "name", "amt"]
        assert read_header(spark, path) == ["id", "name", "amt"]
        got = [tuple(r) for r in df.orderBy("id").collect()]
        assert got == [("1", "a", None), ("2", "b", "5"), ("3", "x\ny", None), ("4", 'q"z', "1")]
        assert all(f.dataType.simpleString() == "string" for f in df.schema.fields)


def test_stringify(spark):
    df = spark.createDataFrame([(1, 5.0, 2.5, datetime.datetime(2024, 1, 5, 0, 0), True)],
                               "` a ` bigint, b double, c double, d timestamp, e boolean")
    row = stringify(df).collect()[0]
    assert stringify(df).columns == ["a", "b", "c", "d", "e"]
    assert tuple(row) == ("1", "5", "2.5", "2024-01-05 00:00:00", "true")
    row2 = stringify(df, {"b": 2}).collect()[0]
    assert (row2.b, row2.c) == ("5.00", "2.5")


def test_number_text(spark):
    cases = [(1e-4, "0.0001"), (12345678.9, "12345678.9"), (1e20, "100000000000000000000"), (-1.5e-7, "-0.00000015"),
             (1.25e10, "12500000000"), (123456.789e3, "123456789"), (float("nan"), "NaN"), (float("inf"), "Infinity"),
             (0.0, "0"), (1e305, "1" + "0" * 305), (None, None)]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x double")
    assert [r.x for r in stringify(df).orderBy(F.col("i").cast("int")).collect()] == [t for _, t in cases]
    small = spark.createDataFrame([(0.1,), (2.5e-5,)], "x float")
    assert [r.x for r in stringify(small).collect()] == ["0.1", "0.000025"]


def test_csv_sink_keeps_every_character(spark, tmp_path):
    texts = ["  x ", 'q"z, w', "a\nb", "back\\slash", '"', ",", " ", "ä\t", None, ""]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, t string")
    write_table(df, str(tmp_path / "out"), "csv", page_rows=3)
    back = {r.id: r.t for r in scan_csv_strings(spark, str(tmp_path / "out")).collect()}
    assert back == {str(i): (t or None) for i, t in enumerate(texts)}
    with pytest.raises(ValueError, match="unknown output format"):
        write_table(df, str(tmp_path / "other"), "xlsx")


def test_file_order(spark, tmp_path):
    spark.range(50).select((99 - F.col("id")).alias("v")).coalesce(1).write.parquet(str(tmp_path / "p"))
    rows = with_file_order(spark.read.parquet(str(tmp_path / "p"))).repartition(7).orderBy("_row_order").collect()
    assert [r.v for r in rows] == [99 - i for i in range(50)]


def test_csv_lines_stay_where_they_are_read(spark, tmp_path):
    """Every record with a quoted line end: lines are neither shuffled nor sorted, only the pieces at the ends of splits are."""
    path = tmp_path / "t.csv"
    path.write_text("id,x\n" + "".join(f'{i},"a\n{i}"\n' for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        df = scan_csv_strings(spark, str(path), row_order=True)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if " line#" in x and ("Exchange" in x or "Window" in x or "Sort" in x)]
        got = [r.x for r in df.orderBy("_row_order").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"a\n{i}" for i in range(2000)]


def test_places_of_csv_rows_are_short_and_in_the_order_of_the_paths(spark, tmp_path):
    """Rows carry the number of their file, not its path; the paths' order is that of the numbers, whatever is in the names."""
    folder = tmp_path / ("a long name " * 8)
    folder.mkdir()
    names = ["b é.csv", "a%20.csv", "a 1.csv", "c+.csv", *[f"p{i}.csv" for i in range(12)]]
    for name in names:
        (folder / name).write_text("id,x\n" + "".join(f'"{name}",{i}\n' for i in range(3)))
    rows = scan_csv_strings(spark, str(folder), row_order=True).orderBy("_row_order").collect()
    lines = spark.read.text(str(folder)).where(F.col("value").endswith(",0")).select(F.split("value", '"')[1].alias("id"), "_metadata.file_path")
    listed = [r.id for r in lines.orderBy("file_path").collect()]
    assert [(r.id, r.x) for r in rows] == [(n, str(i)) for n in listed for i in range(3)]
    assert max(len(r["_row_order"]) for r in rows) <= 42
