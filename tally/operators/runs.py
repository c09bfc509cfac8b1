"""Pairing of duplicate keys by runs of equal rows.

The k-th source row of a key pairs with the k-th target row of the same key, in the
order of the rows' values. Rows of a key and side that are equal in everything the outputs show
are one *run*: its values, its first position and how many rows it has. A key's runs lie one
behind the other on each side, so the pairs are the overlaps of two rows of intervals.
They are found by one sweep over the places where a run begins or a side ends before the other, and there are
no more of them than runs and keys together, however many rows a run stands for.

* ``runs_of`` sums equal rows up before the exchange.
* Keys of ordinary size: one exchange on the key, running sums give the first positions.
* Hot keys: positions come from ``global_positions`` (weighted by the runs' sizes), runs are
  cut at every ``BUCKET`` positions, and each bucket of a key is swept on its own, so
  neither many different rows nor many equal ones meet in one task.

A pair stands for ``_copies`` rows at the positions from ``_rn`` on; ``expanded`` makes
them single rows again where an output needs that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.operators.names import q
from tally.operators.normalize import KEY
from tally.operators.positions import GROUP_ROWS, POS, global_positions

SIDE, RN, NS, NT, HAS_S, HAS_T, COPIES = "_side", "_rn", "_ns", "_nt", "_has_s", "_has_t", "_copies"
_N, _START, _HIGH, _BUCKET = "_run_rows", "_start", "_high", "_bucket"
BUCKET = 65_536      # positions of a hot key that one task sweeps
_NO_END = (1 << 62)
SMALL_KEY_ROWS = 1_000   # rows of a key, both sides together, up to which they are paired as lists


def runs_of(rows: DataFrame) -> DataFrame:
    """Equal rows as one, with their number."""
    return rows.groupBy(*[q(c) for c in rows.columns]).agg(F.count(F.lit(1)).cast("bigint").alias(_N))


def _side_rows() -> Column:
    return F.when(F.col(SIDE) == 0, F.col(NS)).otherwise(F.col(NT))


def _swept(placed: DataFrame, group: list[str], values: list[str], s_names: list[str], t_names: list[str]) -> DataFrame:
    """Overlaps of the two sides' runs within each group, which ends at ``_high``. ``values`` hold the values of a row's
    own side: of a source row those named ``s_names``, of a target row ``t_names``."""
    end, high = F.col(_START) + F.col(_N), F.col(_HIGH)
    other_rows = F.when(F.col(SIDE) == 0, F.col(NT)).otherwise(F.col(NS))
    begins = F.struct(F.col(_START).alias("p"), F.lit(True).alias("on"))
    ends = F.struct(end.alias("p"), F.lit(False).alias("on"))
    # this side ends where the other one goes on; where both end, or the group does, no event is needed
    ends_first = (end == _side_rows()) & (end < other_rows) & (end < high)
    events = placed.withColumn("_e", F.explode(F.when(ends_first, F.array(begins, ends)).otherwise(F.array(begins))))
    on = F.col("_e.on")
    state = lambda side, names: F.when(F.col(SIDE) == side, F.struct(
        on.alias("on"), *[F.when(on, q(c)).alias(f"v{i}") for i, c in enumerate(values[:len(names)])]))
    events = events.select(*group, NS, NT, _HIGH, F.col("_e.p").alias("_p"), state(0, s_names).alias("_s"), state(1, t_names).alias("_t"))
    by_place = Window.partitionBy(*group).orderBy("_p")
    so_far = by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # of events at one place all but the last have no length, and the last has seen them all
    until = F.coalesce(F.lead("_p").over(by_place), F.least(F.greatest(NS, NT), high))
    swept = events.select(*group, NS, NT, "_p", F.last("_s", ignorenulls=True).over(so_far).alias("_s"),
                          F.last("_t", ignorenulls=True).over(so_far).alias("_t"),
                          (until - F.col("_p")).alias(COPIES)).where(F.col(COPIES) > 0)
    return swept.select(KEY, F.col("_p").cast("bigint").alias(RN), F.col(COPIES).cast("bigint").alias(COPIES),
                        F.col(NS).cast("bigint").alias(NS), F.col(NT).cast("bigint").alias(NT),
                        F.coalesce("_s.on", F.lit(False)).alias(HAS_S), F.coalesce("_t.on", F.lit(False)).alias(HAS_T),
                        *[F.col(f"_s.v{i}").alias(c) for i, c in enumerate(s_names)],
                        *[F.col(f"_t.v{i}").alias(c) for i, c in enumerate(t_names)])


def cold_pairs(rows: DataFrame, order: list[Column], values: list[str], s_names: list[str], t_names: list[str]) -> DataFrame:
    """Pairs of keys whose runs fit in a task each."""
    before = Window.partitionBy(KEY, SIDE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    by_key = Window.partitionBy(KEY)
    rows_of = lambda side: F.coalesce(F.sum(F.when(F.col(SIDE) == side, F.col(_N))).over(by_key), F.lit(0))
    # a fixed number of partitions: few runs may stand for many rows, so they are not merged by their size
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (runs_of(rows.repartition(tasks, KEY))      # equal rows share a key: summed up where the key is, without an exchange of their own
              .withColumn(_START, F.coalesce(F.sum(_N).over(before), F.lit(0)))
              .withColumn(NS, rows_of(0)).withColumn(NT, rows_of(1)).withColumn(_HIGH, F.lit(_NO_END)))
    return _swept(placed, [KEY], values, s_names, t_names)


def small_pairs(rows: DataFrame, order: list[str], s_names: list[str], t_names: list[str]) -> DataFrame:
    """Pairs of keys that hold at most ``SMALL_KEY_ROWS`` rows: after one exchange a key's rows are two lists, sorted by the columns
    ``order`` (among them all values) and laid side by side. One row a pair, equal rows too."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_s, row = F.col(SIDE) == 0, F.struct(*order)      # in a list nulls come first, as in the sweep
    lists = (rows.repartition(tasks, KEY).groupBy(KEY)
             .agg(F.collect_list(F.when(is_s, row)).alias("_s"), F.collect_list(F.when(~is_s, row)).alias("_t")))
    in_order = lambda c: F.when(F.size(c) > 1, F.sort_array(c)).otherwise(F.col(c)).alias(c)
    pairs = (lists.select(KEY, in_order("_s"), in_order("_t"))
             .select(KEY, F.size("_s").cast("bigint").alias(NS), F.size("_t").cast("bigint").alias(NT), F.posexplode(F.arrays_zip("_s", "_t")).alias(RN, "_p")))
    return pairs.select(KEY, F.col(RN).cast("bigint").alias(RN), F.lit(1).cast("bigint").alias(COPIES), NS, NT,
                        (F.col(RN) < F.col(NS)).alias(HAS_S), (F.col(RN) < F.col(NT)).alias(HAS_T),
                        *[F.col(f"_p._s._v{i}").alias(c) for i, c in enumerate(s_names)],
                        *[F.col(f"_p._t._v{i}").alias(c) for i, c in enumerate(t_names)])


def hot_pairs(rows: DataFrame, order: list[Column], values: list[str], s_names: list[str], t_names: list[str], partitions: int,
              small: bool, bucket: int | None = None) -> DataFrame:
    """Pairs of keys of any size; ``small``: the table of these keys may be broadcast."""
    bucket = bucket or BUCKET
    placed = global_positions(runs_of(rows), order, partitions, group=[KEY, SIDE], weight=_N)
    totals = placed.groupBy(KEY).agg(F.coalesce(F.max(F.when(F.col(SIDE) == 0, F.col(GROUP_ROWS))), F.lit(0)).alias(NS),
                                     F.coalesce(F.max(F.when(F.col(SIDE) == 1, F.col(GROUP_ROWS))), F.lit(0)).alias(NT))
    placed = placed.join(F.broadcast(totals) if small else totals, KEY)
    of = lambda at: ((at - at % bucket) / bucket).cast("bigint")
    pieces = placed.withColumn(_BUCKET, F.explode(F.sequence(of(F.col(POS)), of(F.col(POS) + F.col(_N) - 1))))
    low, high = F.col(_BUCKET) * bucket, (F.col(_BUCKET) + 1) * bucket
    cut = (pieces.withColumn(_START, F.greatest(F.col(POS), low)).withColumn(_HIGH, high)
           .withColumn(_N, F.least(F.col(POS) + F.col(_N), high) - F.greatest(F.col(POS), low)))
    return _swept(cut.repartition(partitions, KEY, _BUCKET), [KEY, _BUCKET], values, s_names, t_names)


def expanded(pairs: DataFrame) -> DataFrame:
    """One row for each position that a pair stands for."""
    nth = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(COPIES) - 1))
    others = [c for c in pairs.columns if c not in (RN, COPIES)]
    return (pairs.select(*[q(c) for c in others], RN, nth.alias("_nth"))
            .select(*[q(c) for c in others], (F.col(RN) + F.col("_nth")).alias(RN)))
