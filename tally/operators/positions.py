"""Global row positions without a single-task ``row_number()``.

``global_positions(df, order, group)`` gives each row its 0-based position
inside its group in ``order``, for groups of any size. With ``weight`` a row stands for
that many equal rows and gets the position of the first of them.

1. range-partition on (group, order) and sort each partition, so a huge group
   spreads over many contiguous partitions (rows that tie are spread at random);
2. tag each row with (partition, local index) and checkpoint once (reliable
   storage in the session's checkpoint folder): both branches below read the
   same numbered copy, so the range bounds cannot differ between them and a
   lost executor does not renumber anything;
3. count rows per (group, partition): at most ``groups + partitions`` rows, joined
   back on both (the join is broadcast if Spark measures the table as small);
4. position = rows of the group in earlier partitions + local index.

``order`` must be a total order (add a unique tie-break) for positions to be
reproducible; rows that tie may take each other's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.session import checkpoint_dir

POS, GROUP_ROWS = "_pos", "_group_rows"
_LOCAL_BITS = 33


def global_positions(df: DataFrame, order: list[Column], partitions: int,
                     group: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """``df`` plus ``_pos`` (0-based, per group) and ``_group_rows``."""
    group = list(group or [])
    checkpoint_dir(df.sparkSession)
    df = df.withColumn("_tie", F.rand(7))     # written with the rows before anything depends on it
    sort_cols = [F.col(g) for g in group] + list(order) + [F.col("_tie")]
    ranked = (df.repartitionByRange(max(1, partitions), *sort_cols).sortWithinPartitions(*sort_cols)
              .withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
              .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
              .drop("_mid", "_tie")
              .checkpoint(eager=True))
    if weight is None:
        ranked, rows = ranked.withColumn("_at", F.col("_loc")), F.count(F.lit(1))
    else:   # rows before it in its partition; a group's part of a partition is one task's at most
        local = Window.partitionBy(*group, "_pid").orderBy("_loc").rowsBetween(Window.unboundedPreceding, -1)
        ranked, rows = ranked.withColumn("_at", F.coalesce(F.sum(weight).over(local), F.lit(0))), F.sum(weight)
    seg = ranked.groupBy(*group, "_pid").agg(F.min("_at").alias("_first"), rows.alias("_n"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    seg = (seg.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
           .withColumn(GROUP_ROWS, F.sum("_n").over(whole)))
    out = ranked.join(seg, [*group, "_pid"])
    return (out.withColumn(POS, F.col("_off") + F.col("_at") - F.col("_first"))
            .drop("_pid", "_loc", "_at", "_first", "_n", "_off"))
