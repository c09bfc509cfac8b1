"""First phase of a comparison: which keys need no pairing at all.

Most rows of most reconciliations agree. So before any row is paired at full width, each
row is boiled down to digests and only its key and these go through the key exchange, summed
up before it. A key *agrees*, and its rows are counted and leave, if

* it has one row on each side and the digests of their cleaned values are equal, or
* it has as many rows on one side as on the other and both sides have the same multiset of
  raw values (ordering and compared columns): then both sides are in the same order
  and every row meets its equal.

Digests are 128 bits; a row with a number that is never equal to itself (nan, inf) gets a
digest of its own side, so its key stays. Agreement only ever leaves out rows without a
difference; a key that differs in digests (values within the numeric tolerance, say) is
decided by the full comparison.

The same pass counts both sides of every key, which gives without further exchanges
the row counts, duplicates, missing and surplus rows, the keys that one side lacks,
and the keys with very many rows. The table of keys that do not agree is written once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tally.functions.clean import clean_number, clean_string
from tally.operators.names import folded, q
from tally.operators.normalize import KEY
from tally.session import scratch_path

NS, NT = "_ns", "_nt"
MASK_BITS = 60       # columns whose nulls one number of the digest can tell


@dataclass(frozen=True)
class Judged:
    """``keys``: _key, _ns, _nt (rows on each side), _open of the keys that do not agree (open) or are hot;
    ``counts``: totals over all keys."""
    keys: DataFrame
    counts: dict[str, int]
    hot_key_rows: int

    @property
    def has_duplicates(self) -> bool:
        """Whether a key that does not agree has several rows on a side."""
        return self.counts["open_duplicates"] > 0

    def one_sided(self, side: str) -> DataFrame:
        """Keys of ``side`` ("source" or "target") that the other side lacks."""
        return self.keys.where((F.col(NT) if side == "source" else F.col(NS)) == 0).select(KEY)

    def two_sided(self) -> DataFrame:
        """Keys on both sides that do not agree."""
        return self.keys.where(F.col("_open") & (F.col(NS) > 0) & (F.col(NT) > 0)).select(KEY)

    def hot(self) -> DataFrame | None:
        """_key, _rows of the keys with more than ``hot_key_rows`` rows; None without any."""
        if self.counts["most_rows"] <= self.hot_key_rows:
            return None
        rows = F.col(NS) + F.col(NT)
        return self.keys.where(rows > self.hot_key_rows).select(KEY, rows.alias("_rows"))


def null_masks(columns: list[Column]) -> list[Column]:
    """Numbers that tell which of the columns are null (a hash alone skips nulls)."""
    masks = []
    for at in range(0, len(columns), MASK_BITS):
        bits = [F.when(c.isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(columns[at:at + MASK_BITS])]
        masks.append(folded(bits, lambda a, b: a.bitwiseOR(b)))
    return masks


def digests(side: DataFrame, number: int, compare: list[str], order_by: list[str], numeric: set[str],
            case_sensitive: bool) -> DataFrame:
    """_key, _side (1 source, -1 target), _c1, _c2 (digest of the cleaned values), _raw (of the values as they are)."""
    raw = [q(c) for c in dict.fromkeys([*order_by, *compare])]
    clean = lambda c: clean_number(q(c)) if c in numeric else clean_string(q(c), case_sensitive)
    cleaned = side.select(KEY, F.xxhash64(*raw, *null_masks(raw)).alias("_raw"), *[clean(c).alias(f"_x{i}") for i, c in enumerate(compare)])
    values = [F.col(f"_x{i}") for i in range(len(compare))]
    numbers = [v for v, c in zip(values, compare) if c in numeric]
    never = lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(False))
    odd = folded([F.lit(False), *map(never, numbers)], lambda a, b: a | b)
    own = F.when(odd, F.lit(number)).otherwise(F.lit(0))     # never equal to the other side's
    told = [*values, *(null_masks(numbers) if numbers else []), own]
    return cleaned.select(KEY, F.lit(number).cast("tinyint").alias("_side"),
                          F.xxhash64(F.lit(1), *told).alias("_c1"), F.xxhash64(F.lit(2), *told).alias("_c2"),
                          F.xxhash64(F.col("_raw"), own).alias("_raw"))


def judge(source: DataFrame, target: DataFrame, compare: list[str], order_by: list[str], numeric: set[str],
          case_sensitive: bool = True, hot_key_rows: int = 2_000_000) -> Judged:
    """Both sides carry ``_key``. One pass and one exchange of keys and digests; the open keys are written to the scratch folder."""
    spark = source.sparkSession
    rows = (digests(source, 1, compare, order_by, numeric, case_sensitive)
            .unionByName(digests(target, -1, compare, order_by, numeric, case_sensitive)))
    is_s = F.col("_side") == 1
    signed = lambda x: F.sum(F.when(is_s, x).otherwise(-x))
    raw = F.col("_raw")
    per_key = rows.groupBy(KEY).agg(
        F.count_if(is_s).alias(NS), F.count_if(~is_s).alias(NT), F.bit_xor("_c1").alias("_c1"), F.bit_xor("_c2").alias("_c2"),
        F.bit_xor("_raw").alias("_x"), signed(raw.bitwiseAND(F.lit(0xFFFFFFFF))).alias("_low"),
        signed(F.shiftrightunsigned(raw, 32)).alias("_high"))
    same_rows = (F.col("_x") == 0) & (F.col("_low") == 0) & (F.col("_high") == 0)
    same_values = (F.col(NS) == 1) & (F.col("_c1") == 0) & (F.col("_c2") == 0)
    open_ = ~((F.col(NS) == F.col(NT)) & (same_rows | same_values))
    s, t = F.col(NS), F.col(NT)
    both, two = (s > 0) & (t > 0), open_ & (s > 0) & (t > 0)
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(name)
    seen = Observation(f"judged-{uuid.uuid4().hex}")
    counted = per_key.observe(
        seen, total(s, "source_rows"), total(t, "target_rows"), total(F.least(s, t), "matched"),
        total(F.when(s == 0, t), "missing_in_source"), total(F.when(t == 0, s), "missing_in_target"),
        total(F.when(both, F.greatest(s - t, F.lit(0))), "surplus_in_source"),
        total(F.when(both, F.greatest(t - s, F.lit(0))), "surplus_in_target"),
        total(F.when(s > 1, s), "duplicate_key_rows_in_source"), total(F.when(t > 1, t), "duplicate_key_rows_in_target"),
        F.count_if(two & ((s > 1) | (t > 1))).cast("bigint").alias("open_duplicates"),
        total(F.when(two, s + t), "open_rows"),
        F.coalesce(F.max(s + t), F.lit(0)).cast("bigint").alias("most_rows"),
        F.coalesce(F.max(F.greatest(s, t)), F.lit(0)).cast("bigint").alias("most"))
    path = scratch_path(spark, f"judged-{uuid.uuid4().hex}")
    keys = (counted.where(open_ | (s + t > hot_key_rows))
            .select(KEY, s.cast("bigint").alias(NS), t.cast("bigint").alias(NT), open_.alias("_open")))
    keys.write.parquet(path)
    return Judged(spark.read.schema(keys.schema).parquet(path), seen.get, hot_key_rows)
