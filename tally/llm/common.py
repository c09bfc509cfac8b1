"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.session import scratch_path

#: A word is a run of anything but blank, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lets Spark delete the shuffle files of a query as soon as it ends, not when the driver's collector finds them unused.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back.

    Cuts the lineage: a lost executor re-reads files instead of redoing the work, and the shuffle files that
    led to the copy are deleted, as nothing reads them again.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checksum_split(column: str = "doc_id") -> Column:
    """crc32 of an id written as text (null id: empty text), the rule that marks held-out rows."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def bounded_labels(labels: DataFrame, column: str, train: Column, bound: int) -> DataFrame:
    """At most about ``bound`` labelled training ids: (doc_id, label).

    One row per id (the larger label where rows disagree); ids or labels that
    are null are left out. Above the bound the ids with the smallest hash are
    kept, so the choice is the same in every run and small enough to broadcast.
    """
    one = (labels.select(F.col("doc_id").alias("doc_id"), F.col(column).cast("int").alias("label"))
           .where("doc_id is not null and label is not null").where(train)
           .groupBy("doc_id").agg(F.max("label").alias("label")))
    n = one.count()
    if n <= bound:
        return one
    share = int(bound / n * (1 << 32))
    return one.where(F.pmod(F.xxhash64("doc_id", F.lit("label sample")), F.lit(1 << 32)) < share)


def one_row_an_id(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, label, text of the chosen ids (doc_id, label; bounded), so as many rows at most: of texts that share an id the first."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


SLICE_BYTES = 2 << 20   # of a batch that a task looks at once


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``size`` bytes (a longer row stands alone with few others), so that
    what a task makes of it, lists of texts above all, stays small."""
    rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``f`` over slices of each Arrow batch of ``df``; no state between them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = f(part)
                if out is not None:
                    yield out
    return df.mapInArrow(run, schema)


#: Keys that are dealt out apart from the others: those with over 1 / HOT_SHARE of all rows, so HOT_SHARE at most.
HOT_SHARE, HOT_LEAST = 10_000, 1_000


def joined_on_hot(rows: DataFrame, keyed: DataFrame, on: str, count: str) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (one row per key) in which no task gets all rows of a frequent key.

    ``count`` says how many of ``rows`` have the key. Keys with more than the
    10,000th part of all rows (and 1,000 at least) are 10,000 at most, whatever the
    input's size; they are broadcast, so their rows stay where they are. The
    others go through an ordinary join, where a key brings no more rows than that.
    The column ``count`` is left out of the result; null keys join nothing.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    bound = max(HOT_LEAST, total // HOT_SHARE)
    hot = F.broadcast(keyed.where(F.col(count) > bound).drop(count))
    cold = keyed.where(F.col(count) <= bound).drop(count)
    spread = rows.join(hot, on)
    rest = rows.join(F.broadcast(keyed.where(F.col(count) > bound).select(on)), on, "left_anti").join(cold, on)
    return spread.unionByName(rest)
