"""Outputs of a reconciliation: counts, summary, missing rows, full data,
the sorted report, top-n, pages and sinks (G1–G9, U3, S4–S8, F14).

Counts come from one aggregate over the paired rows (partial aggregation, a
few counters per task cross the network). The report sort is a range-
partitioned global sort; page numbers use per-partition counts and offsets
instead of a global row_number (which would run in one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions.clean import blank_nulls
from tally.operators.diff import ANY, COLUMN_NAME, src, tgt
from tally.operators.names import folded, q
from tally.operators.normalize import KEY
from tally.operators.pair import MATCHED, MISSING_IN_SOURCE, MISSING_IN_TARGET, STATUS
from tally.operators.positions import POS, global_positions
from tally.operators.runs import COPIES, RN

RECORD_STATUS = "Record Status"
COUNT = "Count"


def _status(name: str) -> Column:
    return F.col(STATUS) == F.lit(name)


def column_counts(paired: DataFrame, fl: dict[str, Column], labels: dict[str, str]) -> DataFrame:
    """Discrepancies per column (only columns with any), most first, then by label; one aggregate."""
    row = paired.agg(F.array(*[F.struct(F.lit(labels[c]).alias(COLUMN_NAME), copies_where(f).alias(COUNT))
                               for c, f in fl.items()]).alias("a"))
    return row.select(F.inline("a")).where(F.col(COUNT) > 0).orderBy(F.desc(COUNT), q(COLUMN_NAME))


def columns_with_diffs(paired: DataFrame, fl: dict[str, Column]) -> DataFrame:
    """Names of compared columns with at least one difference (any over flags)."""
    is_m = _status(MATCHED)
    row = paired.agg(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                        F.max(is_m & f).alias("has_diff")) for c, f in fl.items()]).alias("a"))
    return row.select(F.inline("a")).where(F.col("has_diff")).select("column_name")


#: Counters of a reconciliation, in the order of the summary; ``per_column`` follows them.
COUNTERS = ("source_rows", "target_rows", "matched", "missing_in_source", "missing_in_target", "surplus_in_source",
            "surplus_in_target", "duplicate_key_rows_in_source", "duplicate_key_rows_in_target", "records_affected")


def copies_where(condition: Column) -> Column:
    """How many matched pairs meet the condition (a row stands for ``_copies`` pairs)."""
    return F.coalesce(F.sum(F.when(_status(MATCHED) & condition, F.col(COPIES))), F.lit(0)).cast("bigint")


def difference_counters(fl: dict[str, Column]) -> list[Column]:
    """Aggregates over paired runs: ``records_affected``, then ``n0``, ``n1``, ... per compared column."""
    return [copies_where(F.col(ANY)).alias("records_affected"), *[copies_where(f).alias(f"n{i}") for i, f in enumerate(fl.values())]]


ALL_MATCHED, SOME_DIFFER = "All mapped columns matched perfectly", "Discrepancies found"


def summary(totals: DataFrame, labels: list[str], source_label: str, target_label: str,
            source_name: str, target_name: str) -> DataFrame:
    """Ordered (ordinal, metric, value, text) rows from the one row of ``counters``."""
    n = {c: F.col(c) for c in COUNTERS}
    per_column = [F.struct((-F.col(f"n{i}")).alias("neg"), F.lit(label).alias("label")) for i, label in enumerate(labels)]
    total = folded([F.lit(0).cast("bigint"), *[F.col(f"n{i}") for i in range(len(labels))]], lambda a, b: a + b)
    missing_both = n["missing_in_source"] + n["missing_in_target"]
    S_, T_ = source_label, target_label
    no_text, no_value = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    fixed = [
        (-1, f"{S_} File", no_value, F.lit(source_name)),
        (0, f"{T_} File", no_value, F.lit(target_name)),
        (1, f"{S_} Records Count", n["source_rows"], no_text),
        (2, f"{T_} Records Count", n["target_rows"], no_text),
        (3, "Matched Records", n["matched"], no_text),
        (4, f"Records Missing in {S_}", n["missing_in_source"], no_text),
        (5, f"Records Missing in {T_}", n["missing_in_target"], no_text),
        (6, "Total Missing Records", missing_both, no_text),
        (7, f"Surplus Duplicates in {S_}", n["surplus_in_source"], no_text),
        (8, f"Surplus Duplicates in {T_}", n["surplus_in_target"], no_text),
        (9, f"Duplicate Key Rows in {S_}", n["duplicate_key_rows_in_source"], no_text),
        (10, f"Duplicate Key Rows in {T_}", n["duplicate_key_rows_in_target"], no_text),
        (1000, "Unique Records with Discrepancies", n["records_affected"], no_text),
        (1001, "Total Data Discrepancies (cell-level)", total, no_text),
        (1002, "Total Validation Issues", missing_both + total, no_text),
        (1003, "Status", no_value, F.when(total == 0, F.lit(ALL_MATCHED)).otherwise(F.lit(SOME_DIFFER))),
    ]
    row = lambda o, m, v, t: F.struct(o.cast("bigint").alias("ordinal"), m.alias("metric"),
                                      v.cast("bigint").alias("value"), t.alias("text"))
    lines = F.array(*[row(F.lit(o), F.lit(m), v, t) for o, m, v, t in fixed])
    ranked = F.sort_array(F.filter(F.array(*per_column), lambda x: x["neg"] < 0))
    columns = F.transform(ranked, lambda x, i: row(F.lit(100) + i, F.concat(F.lit("Discrepancies: "), x["label"]), -x["neg"], no_text))
    return totals.select(F.inline(F.concat(lines, columns)))


def with_comments(df: DataFrame, comment_columns: tuple[str, ...]) -> DataFrame:
    return df.withColumns({c: F.lit("") for c in comment_columns}) if comment_columns else df


def full_data(paired: DataFrame, compare: list[str]) -> DataFrame:
    """Side-by-side ``{c}_S``, ``{c}_T`` and ``Record Status`` for matched and
    missing rows (surplus duplicates are not part of it), one projection."""
    keep = paired.where(F.col(STATUS).isin(MATCHED, MISSING_IN_TARGET, MISSING_IN_SOURCE))
    s_on = F.col(STATUS).isin(MATCHED, MISSING_IN_TARGET)
    t_on = F.col(STATUS).isin(MATCHED, MISSING_IN_SOURCE)
    return keep.select(*[F.when(s_on, blank_nulls(src(c))).otherwise(F.lit("")).alias(f"{c}_S") for c in compare],
                       *[F.when(t_on, blank_nulls(tgt(c))).otherwise(F.lit("")).alias(f"{c}_T") for c in compare],
                       F.col(STATUS).alias(RECORD_STATUS))


def report_order(keys: list[str]) -> list[Column]:
    return [F.col(f"`{COLUMN_NAME}`").asc(), *[q(k).asc() for k in keys], F.col(KEY).asc(), F.col(RN).asc()]


def report_columns(keys: list[str], include: list[str], value_names: tuple[str, str], present: list[str]) -> list[str]:
    cols = list(keys) + [c for c in include if c not in keys] + [COLUMN_NAME, *value_names]
    return [c for c in cols if c in present]


def discrepancy_report(cells: DataFrame, keys: list[str], include: list[str], value_names: tuple[str, str],
                       comment_columns: tuple[str, ...] = ()) -> DataFrame:
    """Report layout: keys, include columns, label, values, reviewer columns;
    sorted by label then keys (range-partitioned global sort)."""
    cols = report_columns(keys, include, value_names, cells.columns)
    ordered = cells.orderBy(*report_order(keys)).select(*[q(c) for c in cols])
    return with_comments(ordered, comment_columns)


MERGED_ROWS = 10_000   # rows a top-n may send from each task to be merged
PREFIX = 2             # characters by which a round of ``first_rows`` looks further into a value


def first_rows(cells: DataFrame, columns: list[str], n: int, most: int) -> Column:
    """A condition that holds for the first ``n`` rows by ``columns`` (texts without nulls) and at most ``most`` others
    (or others equal to the n-th in all of them).

    Rounds of counts by the beginnings of one column's values narrow the bucket that holds the n-th
    row, until what it holds besides is few: nothing is sorted, and a round brings a row a beginning to the driver.
    """
    surely, bucket, need = F.lit(False), F.lit(True), n
    for name in columns:
        length = 0
        while True:
            length += PREFIX
            part = F.substring(q(name), 1, length)
            rounds = (cells.where(bucket).groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max(F.length(q(name))).alias("longest"))
                      .orderBy("p").collect())
            upto, found = 0, None
            for r in rounds:
                if upto + r["n"] >= need:
                    found = r
                    break
                upto += r["n"]
            if found is None:                       # fewer rows than asked for
                return surely | bucket
            surely = surely | (bucket & (part < F.lit(found["p"])))
            bucket = bucket & (part == F.lit(found["p"]))
            need -= upto
            if found["n"] - need <= most:
                return surely | bucket
            if found["longest"] <= length:          # all of the bucket have the same value here
                break
    return surely | bucket


def top_n(cells: DataFrame, keys: list[str], include: list[str], value_names: tuple[str, str], n: int,
          comment_columns: tuple[str, ...] = (), partitions: int = 1) -> DataFrame:
    """First ``n`` report rows in report order: each task's own first rows merged, or, where that merge would be large,
    the rows up to the n-th (``first_rows``), of which those with the first ``n`` positions stay. ``cells`` is read
    several times then."""
    cols = report_columns(keys, include, value_names, cells.columns)
    order = report_order(keys)
    if n <= MERGED_ROWS:
        first = cells.orderBy(*order).limit(n)
    else:
        few = cells.where(first_rows(cells, [COLUMN_NAME, *keys, KEY], n, MERGED_ROWS))
        first = global_positions(few, order, partitions).where(F.col(POS) < n).orderBy(*order)
    return with_comments(first.select(*[q(c) for c in cols]), comment_columns)


FILES_OF_A_TASK = 1000     # files of a task that its three-digit counter keeps in order by name


def pages_of_a_task(rows: int, page_rows: int, partitions: int) -> int:
    """How many pages a task writes: one where there are few, else so many that about ``partitions`` tasks write all."""
    return min(FILES_OF_A_TASK, max(1, -(-rows // (page_rows * partitions))))


def page_files(cells: DataFrame, keys: list[str], include: list[str], value_names: tuple[str, str], page_rows: int,
               partitions: int, rows: int, comment_columns: tuple[str, ...] = ()) -> DataFrame:
    """Report rows so dealt out that each partition holds the next ``pages_of_a_task`` pages of ``page_rows`` rows in report order:
    written with ``page_rows`` rows a file at most, every file but the last has exactly that many. ``rows``: how many there are."""
    cols = report_columns(keys, include, value_names, cells.columns)
    each = page_rows * pages_of_a_task(rows, page_rows, partitions)
    placed = global_positions(cells, report_order(keys), partitions)
    task = ((F.col(POS) - F.col(POS) % each) / each).cast("int")
    dealt = placed.repartitionById(max(1, -(-rows // each)), task).sortWithinPartitions(POS)
    return with_comments(dealt.select(*[q(c) for c in cols]), comment_columns)


def paginate(cells: DataFrame, keys: list[str], include: list[str], value_names: tuple[str, str],
             page_rows: int, partitions: int) -> DataFrame:
    """Report rows with a 1-based ``page`` of ``page_rows`` rows each."""
    cols = report_columns(keys, include, value_names, cells.columns)
    pos = global_positions(cells, report_order(keys), partitions)
    return pos.select(*[q(c) for c in cols], (F.floor(F.col("_pos") / page_rows) + 1).cast("bigint").alias("page"))
