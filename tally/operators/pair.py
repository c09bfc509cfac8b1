"""Pair source rows with target rows (positional keys, match, missing, surplus).

The k-th source row of a key pairs with the k-th target row of the same key. The
result has one row per pair of runs of equal rows (see ``runs``): ``_copies`` pairs at the
positions from ``_rn`` on, the values of each side as ``_s_{column}`` and
``_t_{column}``, and a status:

* ``MATCHED``            both present
* ``MISSING_IN_TARGET``  key absent from the target
* ``MISSING_IN_SOURCE``  key absent from the source
* ``SURPLUS_IN_SOURCE``  key on both sides, source holds more duplicates
* ``SURPLUS_IN_TARGET``  mirror

Only key, compared and context columns go through the exchange. Duplicates are
numbered by ``order_by``, then by all of these columns (ascending, nulls first):
rows that still tie are equal in everything the outputs show, so the result does
not depend on partitions, cores or retries.

Four ways, all with the same rows:

* no key repeats (``judge`` has counted them): one full outer join on the key, no positions;
* keys that repeat, none with many rows: a key's rows as two lists side by side (``small_pairs``);
* keys that repeat: runs, one exchange on the key, one sweep (``cold_pairs``);
* hot keys, with more than ``hot_key_rows`` rows: runs spread by order and position (``hot_pairs``).
  The keys are counted by ``judge`` already, however many there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.operators.names import q
from tally.operators.normalize import KEY
from tally.operators.positions import GROUP_ROWS, POS, global_positions
from tally.operators.runs import COPIES, HAS_S, HAS_T, NS, NT, RN, SIDE, cold_pairs, hot_pairs, small_pairs

STATUS = "_status"
MATCHED = "MATCHED"
MISSING_IN_TARGET = "MISSING_IN_TARGET"
MISSING_IN_SOURCE = "MISSING_IN_SOURCE"
SURPLUS_IN_SOURCE = "SURPLUS_IN_SOURCE"
SURPLUS_IN_TARGET = "SURPLUS_IN_TARGET"

HOT_KEY_ROWS = 2_000_000     # rows of both sides above which a key takes the range path
BROADCAST_KEYS = 10_000      # hot keys up to which their list is broadcast, else joined


def source_name(c: str) -> str:
    return f"_s_{c}"


def target_name(c: str) -> str:
    return f"_t_{c}"


def _tag(df: DataFrame, side: int, columns: list[str], width: int, others: list[str]) -> DataFrame:
    """Side row → (_key, _side, _o*, _v*: its own values, nulls up to ``width``). Both sides share the columns, as a row has
    values of one side only: half as wide as with columns for each."""
    values = [q(c) for c in columns] + [F.lit(None).cast("string")] * (width - len(columns))
    return df.select(q(KEY), F.lit(side).cast("tinyint").alias(SIDE), *[q(c).alias(f"_o{i}") for i, c in enumerate(others)],
                     *[v.alias(f"_v{i}") for i, v in enumerate(values)])


def _unique_pairs(source: DataFrame, target: DataFrame, source_cols: list[str], target_cols: list[str]) -> DataFrame:
    """Pairs of keys of which no side has two rows."""
    s = source.select(KEY, F.lit(True).alias("_in_s"), *[q(c).alias(source_name(c)) for c in source_cols])
    t = target.select(KEY, F.lit(True).alias("_in_t"), *[q(c).alias(target_name(c)) for c in target_cols])
    has = {HAS_S: F.coalesce("_in_s", F.lit(False)), HAS_T: F.coalesce("_in_t", F.lit(False))}
    one = lambda n: F.lit(n).cast("bigint")
    return s.join(t, KEY, "full_outer").select(
        KEY, one(0).alias(RN), one(1).alias(COPIES), has[HAS_S].cast("bigint").alias(NS), has[HAS_T].cast("bigint").alias(NT),
        *[c.alias(n) for n, c in has.items()], *[q(source_name(c)) for c in source_cols], *[q(target_name(c)) for c in target_cols])


def classify(paired: DataFrame) -> DataFrame:
    status = (F.when(F.col(HAS_S) & F.col(HAS_T), F.lit(MATCHED))
              .when(F.col(HAS_S) & (F.col(NT) == 0), F.lit(MISSING_IN_TARGET))
              .when(F.col(HAS_S), F.lit(SURPLUS_IN_SOURCE))
              .when(F.col(NS) == 0, F.lit(MISSING_IN_SOURCE))
              .otherwise(F.lit(SURPLUS_IN_TARGET)))
    return paired.withColumn(STATUS, status)


def hot_keys_of(keys: DataFrame, total_rows: int, hot_key_rows: int = HOT_KEY_ROWS) -> DataFrame | None:
    """(_key, rows) of the keys with more than ``hot_key_rows`` rows; None if the rows are too few for any."""
    if total_rows <= hot_key_rows:
        return None
    return (keys.select(KEY).groupBy(KEY).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_key_rows)
            .checkpoint(eager=True))


def _is_small(hot: DataFrame) -> bool:
    return hot.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS


def _split(df: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of hot keys, all other rows."""
    marks = hot.select(KEY, F.lit(True).alias("_hot"))
    marks = F.broadcast(marks) if _is_small(hot) else marks
    marked = df.join(marks, KEY, "left")
    return marked.where("_hot").drop("_hot"), marked.where("_hot is null").drop("_hot")


def estimate_partitions(total_rows: int, rows_per_partition: int = 2_000_000) -> int:
    """Partitions for ``total_rows`` rows at about 2 M rows each."""
    return max(1, math.ceil(total_rows / rows_per_partition))


def _hot_partitions(hot: DataFrame) -> int:
    rows = hot.agg(F.sum("_rows")).first()[0] or 0
    return max(int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions")), estimate_partitions(rows))


def pair_rows(source: DataFrame, target: DataFrame, source_cols: list[str], target_cols: list[str],
              order_by: list[str], hot: DataFrame | None = None, unique: bool = False, small: bool = False) -> DataFrame:
    """Paired and classified runs (lazy). ``source``/``target`` carry ``_key``; ``hot`` lists keys for the spread path;
    ``unique``: no key has two rows on a side; ``small``: none has more than ``SMALL_KEY_ROWS`` on both."""
    if unique:
        return classify(_unique_pairs(source, target, source_cols, target_cols))
    width = max(len(source_cols), len(target_cols))
    # an ordering column that is at the same place among both sides' values is not carried twice
    at = {c: i for i, (c, d) in enumerate(zip(source_cols, target_cols)) if c == d}
    others = [c for c in order_by if c not in at]
    u = (_tag(source, 0, source_cols, width, others)
         .unionByName(_tag(target, 1, target_cols, width, others)))
    values = [f"_v{i}" for i in range(width)]
    first = [f"_v{at[c]}" if c in at else f"_o{others.index(c)}" for c in order_by]
    by = list(dict.fromkeys([*first, *values]))
    order = [F.col(c).asc_nulls_first() for c in by]
    names = [source_name(c) for c in source_cols], [target_name(c) for c in target_cols]
    if hot is None and small:
        return classify(small_pairs(u, by, *names))
    if hot is None:
        return classify(cold_pairs(u, order, values, *names))
    hot_rows, cold_rows = _split(u, hot)
    spread = hot_pairs(hot_rows, order, values, *names, _hot_partitions(hot), _is_small(hot))
    return classify(cold_pairs(cold_rows, order, values, *names).unionByName(spread))


def only_keys(side: DataFrame, keys: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Rows of ``side`` whose key is listed. Rows of ``hot`` keys (listed as well) stay where they are."""
    if hot is None or not _is_small(hot):
        return side.join(keys, KEY, "left_semi")
    marks = F.broadcast(hot.select(KEY))
    return (side.join(marks, KEY, "left_semi")
            .unionByName(side.join(marks, KEY, "left_anti").join(keys, KEY, "left_semi")))


def number_within_key(df: DataFrame, order: list[Column], hot: DataFrame | None = None) -> DataFrame:
    """``df`` (with ``_key``) plus ``_rn``: 0-based position inside its key in ``order``."""
    w = Window.partitionBy(KEY).orderBy(*order)
    number = lambda d: d.withColumn(RN, (F.row_number().over(w) - 1).cast("bigint"))
    if hot is None:
        return number(df)
    hot_rows, cold_rows = _split(df, hot)
    spread = (global_positions(hot_rows, order, _hot_partitions(hot), group=[KEY])
              .withColumn(RN, F.col(POS).cast("bigint")).drop(POS, GROUP_ROWS))
    return number(cold_rows).unionByName(spread)


def duplicate_key_counts(df: DataFrame) -> DataFrame:
    """One row: rows, rows whose key occurs more than once, and such keys. ``df`` carries ``_key``."""
    per_key = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    many = F.col("n") > 1
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"),
                       F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).cast("bigint").alias("duplicate_rows"),
                       F.count_if(many).cast("bigint").alias("duplicate_keys"))
