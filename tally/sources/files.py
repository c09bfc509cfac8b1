"""Sources: all-string CSV scan and header-only read.

Parquet and other typed sources are read with ``spark.read`` and passed
through ``tally.operators.normalize.stringify`` (S2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.operators.names import q
from tally.sources import csv_splits


def csv_reader(spark: SparkSession, multi_line: bool = True):
    """Spark's own reader with every column a string; empty → null; short rows null-filled, long rows
    truncated (PERMISSIVE); quoted newlines and doubled quotes understood. With
    ``multi_line`` it reads each file in one task."""
    return (spark.read.option("header", True).option("inferSchema", False)
            .option("mode", "PERMISSIVE").option("multiLine", multi_line)
            .option("escape", '"').option("quote", '"').option("encoding", "UTF-8"))


def scan_csv_strings(spark: SparkSession, path: str, multi_line: bool = True, row_order: bool = False) -> DataFrame:
    """Read CSV with every value as text; header names trimmed, a leading
    byte-order mark dropped, blank header cells dropped, '' → null.

    Large files are read in splits, quoted line ends included (see ``csv_splits``). ``multi_line=False``
    leaves out the work that these need, for files without any. ``row_order`` adds ``_row_order``: text that
    sorts rows by file and place in it, for ``order_by=("_row_order",)``.
    """
    header = csv_reader(spark, multi_line).csv(path)       # the names; no data is read
    if multi_line or row_order:
        df = csv_splits.scan(spark, path, len(header.columns), ROW_ORDER if row_order else None)
    else:
        df = header.toDF(*[f"_c{i}" for i in range(len(header.columns))])
    cols = []
    for i, name in enumerate(header.columns):
        clean = name.lstrip("\ufeff").strip()
        if clean:
            cols.append(F.nullif(F.col(f"_c{i}"), F.lit("")).alias(clean))
    return df.select(*cols, *([ROW_ORDER] if row_order else []))


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names only (trimmed, blanks dropped); reads the first line."""
    names = csv_reader(spark, multi_line=False).csv(path).columns
    return [n.lstrip("\ufeff").strip() for n in names if n.lstrip("\ufeff").strip()]


ROW_ORDER = "_row_order"


def with_file_order(df: DataFrame) -> DataFrame:
    """``df``, as read from Parquet files (CSV: ``scan_csv_strings(row_order=True)``), plus ``_row_order``: text that sorts rows by file and place in it.

    Both tables read this way and ``order_by=("_row_order",)`` pair duplicates in the
    order in which the files hold them, whatever later stages do to the partitions.
    """
    place = F.concat(F.col("_metadata.file_path"), F.lit(":"), F.lpad(F.col("_metadata.row_index").cast("string"), 20, "0"))
    return df.select("*", place.alias(ROW_ORDER))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", page_rows: int | None = None) -> None:
    """Write a complete output as Parquet or CSV, ``page_rows`` rows a file at most.

    CSV keeps every character: quotes are doubled, blanks are not trimmed, empty and
    null are both written as nothing. ``scan_csv_strings`` reads it back.
    """
    writer = df.write.mode("overwrite")
    if page_rows:
        writer = writer.option("maxRecordsPerFile", page_rows)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        (writer.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "")
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        raise ValueError(f"unknown output format {fmt!r}: parquet or csv")
