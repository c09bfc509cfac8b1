"""Cell comparison on matched pairs: flags, any-diff filter, melt.

All flags are computed in one projection; rows without a difference are left out
before the melt to one row per differing cell, a single ``inline`` generator, so
the matched rows are read once whatever the number of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions.clean import PLAIN_NUMBER, blank_nulls, clean_number, clean_string, diff_numeric, diff_string, seldom
from tally.operators.names import q
from tally.operators.normalize import KEY
from tally.operators.pair import MATCHED, STATUS, source_name, target_name
from tally.operators.runs import COPIES, RN, expanded

COLUMN_NAME = "Column Name"
ANY = "_any"     # true when any compared column of a pair differs


def src(c: str) -> Column:
    return q(source_name(c))


def tgt(c: str) -> Column:
    return q(target_name(c))


def flag_name(c: str) -> str:
    return f"__diff_{c}"


def matched(paired: DataFrame) -> DataFrame:
    return paired.where(F.col(STATUS) == MATCHED)


def stored_flags(compare: list[str]) -> dict[str, Column]:
    """Flags already materialised as ``__diff_{c}`` columns (see ``with_flags``)."""
    return {c: q(flag_name(c)) for c in compare}


def with_flags(paired: DataFrame, fl: dict[str, Column]) -> DataFrame:
    """Matched pairs plus one boolean ``__diff_{c}`` per compared column."""
    return matched(paired).withColumns({flag_name(c): f for c, f in fl.items()})


def add_flags(paired: DataFrame, compare: list[str], numeric: set[str], case_sensitive: bool = True) -> DataFrame:
    """All pairs plus ``__diff_{c}`` (false unless matched and different).

    Most cells of a pair are the same text on both sides, which is no difference whatever the rule (a number
    that is never equal to itself has a letter in it); only other cells are cleaned and compared, without
    generated code (see ``seldom``), so that of the usual way stays small. Staged: flags in one projection, their union
    in the next, which Spark keeps apart as it reads them more than once."""
    base = paired.columns
    is_m = F.col(STATUS) == MATCHED

    def differs(c: str) -> Column:
        s, t = blank_nulls(src(c)), blank_nulls(tgt(c))
        same = (s == t) & s.rlike(PLAIN_NUMBER) if c in numeric else s == t
        rule = ((lambda p: diff_numeric(clean_number(p["s"]), clean_number(p["t"]))) if c in numeric else
                (lambda p: diff_string(clean_string(p["s"], case_sensitive), clean_string(p["t"], case_sensitive))))
        return F.when(is_m & ~same, seldom(F.struct(s.alias("s"), t.alias("t")), rule)).otherwise(F.lit(False))

    flags = {flag_name(c): F.coalesce(differs(c), F.lit(False)) for c in compare}
    marked = paired.select(*[q(c) for c in base], *[v.alias(k) for k, v in flags.items()])
    # Marked as depending on the partition (it does not), so that the optimizer leaves filters on it
    # where they are instead of copying every rule into the filter's condition.
    any_differs = any_flag({k: q(k) for k in flags}) & (F.spark_partition_id() >= 0)
    return marked.select("*", any_differs.alias(ANY))


def any_flag(fl: dict[str, Column]) -> Column:
    """True when any column differs: ``greatest`` over the boolean flags.
    Code generation splits its arguments into separate methods (a plain OR
    chain of many cleaning rules overflows the 64 KB method limit), and no
    higher-order function is involved (those are evaluated interpreted)."""
    flags = list(fl.values())
    if not flags:
        return F.lit(False)
    return flags[0] if len(flags) == 1 else F.greatest(*flags)


def mismatched(paired: DataFrame) -> DataFrame:
    """Matched pairs with at least one differing column."""
    return matched(paired).where(F.col(ANY))


def cells(paired: DataFrame, fl: dict[str, Column], labels: dict[str, str],
          context: list[str], value_names: tuple[str, str]) -> DataFrame:
    """One row per differing cell: context columns (source side), column label,
    source value and target value (normalised, not cleaned; null → '')."""
    # Only rows with a difference reach the generator, which holds plain columns:
    # no higher-order function (interpreted) and no rule in its body.
    names = list(fl)
    rows = mismatched(paired)
    rows = expanded(rows) if COPIES in rows.columns else rows
    staged = rows.select(
        F.col(KEY), F.col(RN), *[src(c).alias(c) for c in context],
        *[f.alias(f"_f{i}") for i, f in enumerate(fl.values())],
        *[blank_nulls(src(c)).alias(f"_sv{i}") for i, c in enumerate(names)],
        *[blank_nulls(tgt(c)).alias(f"_tv{i}") for i, c in enumerate(names)])
    arr = F.array(*[F.struct(F.col(f"_f{i}").alias("_f"), F.lit(labels[c]).alias("_c"),
                             F.col(f"_sv{i}").alias("_sv"), F.col(f"_tv{i}").alias("_tv"))
                    for i, c in enumerate(names)])
    exploded = staged.select(F.col(KEY), F.col(RN), *[q(c) for c in context], F.inline(arr)).where(F.col("_f"))
    sv, tv = value_names
    return exploded.select(KEY, RN, *[q(c) for c in context],
                           F.col("_c").alias(COLUMN_NAME), F.col("_sv").alias(sv), F.col("_tv").alias(tv))
