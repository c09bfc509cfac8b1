"""Session helpers: a local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tally") -> SparkSession:
    """Local session for tests and the benchmark (UI off, UTC, AQE on)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.driver.memory", os.environ.get("TALLY_DRIVER_MEMORY", "16g"))
               # Generated code for wide rule sets exceeds HotSpot's 8000-byte
               # JIT limit; let the JVM compile it (set the same option in
               # spark.executor.extraJavaOptions on a cluster).
               .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
               .config("spark.executor.extraJavaOptions", "-XX:-DontCompileHugeMethods"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without one (tests) gets a private folder, registered as
    the checkpoint directory; on a cluster its executors could not share it, so
    there a missing setting is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tally-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext.getCheckpointDir() or d
    return d


def scratch_path(spark: SparkSession, name: str | None = None) -> str:
    """A fresh path under the checkpoint folder for intermediate tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tally/{name or uuid.uuid4().hex}"


SPREAD_BYTES = 1 << 30   # input up to which rows are dealt out before work that is done per cell


def spread_small(df: DataFrame, rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rule(df)`` for a narrow rule. If Spark estimates ``df`` at ``SPREAD_BYTES`` at most, its rows are dealt out over
    ``spark.sql.shuffle.partitions`` and the result is written once (Parquet in the scratch folder).

    A small table is often one file that Spark reads in one task; dealt out in a plan that is read several times,
    its rows would pass through that task, a sort and an exchange each time. A large table has many splits by itself and
    is left as it is. The columns of the result are texts.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > SPREAD_BYTES:
        return rule(df)
    spark = df.sparkSession
    rows = rule(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    path = scratch_path(spark, f"side-{uuid.uuid4().hex}")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
