"""Column profiling: choose the compare rule of each column.

Two grouped counts over whole columns, no sample. The first is a histogram of
*shapes*: cells are turned into rows (column number, text) and a text into its shape, in
which every digit stands for all digits. The rules (date-like, castable, dash, sentinel) see only
classes of characters, so they say the same of a text and of its shape and run
once per shape, of which a column has few. A text that begins with a letter of no number or sentinel is
decided by that letter; texts with other characters than numbers and dates have, or very long ones,
are decided on the spot. Histograms add up, so cells are summed up before the shuffle. The second
count looks at the columns that may be dates only, for the shares of the known formats. The
driver gets one row of counters per column and side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions.clean import NUMBER_SHAPE, blank_nulls, normalize_key, seldom
from tally.functions.dates import (DATE_SHARE, FORMATS, DateFormat, date_like, fallback_parse, is_sentinel, parse_with,
                                   py_strip)
from tally.operators.names import q

# Fixed values of the number detection rule.
NUMERIC_SENTINELS = ["", "nan", "None", "NaN"]
NUMERIC_SHARE = 0.8
DASH_SHARE = 0.2


@dataclass(frozen=True)
class DateDecision:
    column: str
    nonsentinel: int
    date_like: int
    parse_counts: tuple[int, ...]
    explicit: bool
    is_date: bool
    fmt: DateFormat | None


@dataclass(frozen=True)
class NumberDecision:
    """Pooled over both sides, on the values that are compared."""
    column: str
    nonsentinel: int
    castable: int
    with_dash: int

    @property
    def is_numeric(self) -> bool:
        n = self.nonsentinel
        return n > 0 and self.castable >= NUMERIC_SHARE * n and self.with_dash < DASH_SHARE * n


@dataclass(frozen=True)
class Profile:
    source_dates: dict[str, DateDecision]
    target_dates: dict[str, DateDecision]
    numbers: dict[str, NumberDecision]
    total_rows: int

    @property
    def numeric(self) -> set[str]:
        return {c for c, d in self.numbers.items() if d.is_numeric}


def numeric_stats(values: Column) -> tuple[Column, Column, Column]:
    """(non-sentinel, castable, contains '-') indicators; nulls are ignored."""
    real = values.isNotNull() & ~values.isin(NUMERIC_SENTINELS)
    castable = F.regexp_replace(values, "[%,]", "").rlike(NUMBER_SHAPE)
    return real, real & castable, real & values.contains("-")


def _raw_cells(df: DataFrame, columns: list[str], keys: set[str], side: str) -> DataFrame:
    """side, column_name, raw text, is_key: one row per cell."""
    cell = F.array(*[F.struct(F.lit(c).alias("column_name"), blank_nulls(q(c)).alias("raw"), F.lit(c in keys).alias("is_key"))
                     for c in columns])
    return (df.select(F.inline(cell))
            .select(F.lit(side).alias("side"), "column_name", "raw", "is_key"))


def _judged_cells(cells: DataFrame) -> DataFrame:
    """Raw cells, their text as a key is compared, the stripped text, and whether it looks like a date."""
    rows = cells.withColumn("stripped", py_strip(F.col("raw")))
    rows = rows.select("*", F.when(F.col("is_key"), normalize_key("raw")).otherwise(F.col("raw")).alias("final"),
                       (~is_sentinel(F.col("stripped"))).alias("real"))
    return rows.withColumn("looks", F.col("real") & date_like(F.col("stripped")))


# A shape is "S" and the text with its digits replaced, or "D" and the verdicts as 0 or 1 in the order of VERDICTS.
VERDICTS = ("real", "looks", "n_real", "n_cast", "n_dash")
LONGEST_SHAPE = 64
#: Characters of numbers, dates and sentinels; blanks other than the plain one are decided on the spot.
#: Numbers that are no date and no sentinel, as a key too (eight digits may be a date), and dates that are no number.
SURE_NUMBER = r"^(?:[0-9]{1,7}+|[0-9]{9,}+|[0-9]++\.[0-9]++)\z"
SURE_DATE = r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9:]*+)?+|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[-/][0-9]{2}[-/][0-9]{4})\z"
TAME = "^[-+0-9.,%/: nNaAoOeEiIfFtTyY]*$"

#: A date and a valid time of day.
TIMED = r"^[-/0-9]{8,10}[T ](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\z"


def _opens_with_other_letter(text: Column) -> Column:
    """The first character is an ASCII letter with which no number, date or sentinel begins, or a letter that goes on no number
    or date comes after one to three digits ("1-URGENT", "12 Main Street", "3rd")."""
    return text.rlike("^(?:[A-HJ-MO-Za-hj-mo-z]|[0-9]{1,3}+(?:[- ][A-Za-z]|[A-DF-Za-df-z]))")


def _verdicts(cells: DataFrame) -> DataFrame:
    """``VERDICTS`` of each row of ``_judged_cells``, as columns."""
    real, castable, dash = numeric_stats(F.col("final"))
    return cells.select("*", real.alias("n_real"), castable.alias("n_cast"), dash.alias("n_dash"))


def shape_histogram(cells: DataFrame) -> DataFrame:
    """side, column_name, is_key, shape, n: how many cells of a column have which shape."""
    raw = F.col("raw")

    def told(x: Column) -> Column:
        raw, is_key = x["raw"], x["is_key"]
        stripped = py_strip(raw)
        real = ~is_sentinel(stripped)
        bits = [real, real & date_like(stripped), *numeric_stats(F.when(is_key, normalize_key(raw)).otherwise(raw))]
        return F.concat(F.lit("D"), *[F.when(b, F.lit("1")).otherwise(F.lit("0")) for b in bits])

    digits = F.when(F.col("is_key"), F.translate(raw, "23456789", "1" * 8)).otherwise(F.translate(raw, "023456789", "1" * 9))
    shape = (F.when(raw.rlike(SURE_NUMBER), F.lit("D10110"))
             .when(_opens_with_other_letter(raw), F.when(raw.contains("-"), F.lit("D10101")).otherwise(F.lit("D10100")))
             .when(raw.rlike(SURE_DATE), F.when(raw.contains("-"), F.lit("D11101")).otherwise(F.lit("D11100")))
             .when((F.length(raw) <= LONGEST_SHAPE) & raw.rlike(TAME), F.concat(F.lit("S"), digits))
             .otherwise(seldom(F.struct("raw", "is_key"), told)))
    return cells.groupBy("side", "column_name", "is_key", shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def text_counts(cells: DataFrame) -> DataFrame:
    """First step: one row of counters per side and column, from raw cells."""
    shapes = shape_histogram(cells).withColumn("raw", F.substring("shape", 2, LONGEST_SHAPE))
    judged = _verdicts(_judged_cells(shapes))
    told = F.substring("shape", 1, 1) == "D"
    n = lambda i: F.coalesce(F.sum(F.when(F.when(told, F.substring("shape", 2 + i, 1) == "1").otherwise(F.col(VERDICTS[i])),
                                          F.col("n"))), F.lit(0)).cast("bigint")
    return judged.groupBy("side", "column_name").agg(
        F.sum("n").alias("rows"), n(0).alias("nonsentinel"), n(1).alias("date_like"),
        n(2).alias("numbers_of"), n(3).alias("castable"), n(4).alias("with_dash"))


def format_counts(cells: DataFrame) -> DataFrame:
    """Second step: per side and column how many texts each known format parses (``parsed_j``; ``exact_j`` without
    stripping), and the number counters of the values that the no-format rule leaves."""
    # texts are counted before they are tested; a valid time of day changes no verdict, so they are about as many as days
    raw = F.col("raw")
    texts = F.when(raw.rlike(TIMED), F.concat(F.substring(raw, F.lit(1), F.length(raw) - 8), F.lit("00:00:00"))).otherwise(raw)
    cells = cells.groupBy("side", "column_name", "is_key", texts.alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    cells, looks = _judged_cells(cells), F.col("looks")
    same = F.col("raw") == F.col("stripped")
    parsed = [(looks & parse_with(F.col("stripped"), f).isNotNull()).alias(f"p{j}") for j, f in enumerate(FORMATS)]
    real, castable, dash = numeric_stats(F.col("final"))
    tested = cells.select("side", "column_name", "n", "real", same.alias("same"), *parsed,
                          (looks & fallback_parse("raw").isNotNull()).alias("dated"),
                          real.alias("n_real"), castable.alias("n_cast"), dash.alias("n_dash"))
    dated = F.col("dated")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return tested.groupBy("side", "column_name").agg(
        n(F.col("real")).alias("nonsentinel"),
        *[n(F.col(f"p{j}")).alias(f"parsed_{j}") for j in range(len(FORMATS))],
        *[n(F.col(f"p{j}") & F.col("same")).alias(f"exact_{j}") for j in range(len(FORMATS))],
        n(dated | F.col("n_real")).alias("f_numbers_of"), n(~dated & F.col("n_cast")).alias("f_castable"),
        n(~dated & F.col("n_dash")).alias("f_with_dash"))


def enough(n: int) -> float:
    """How many of ``n`` texts must match for a column to count as dates, or for a format to be chosen."""
    return max(n * DATE_SHARE, 1)


def chosen_format(counts) -> DateFormat | None:
    """The first format in list order that reaches the share."""
    n = counts["nonsentinel"] if counts else 0
    return next((f for j, f in enumerate(FORMATS) if n and counts[f"parsed_{j}"] >= enough(n)), None)


def _by_column(counts: DataFrame) -> dict:
    return {(r["side"], r["column_name"]): r for r in counts.collect()}


def profile_both(source: DataFrame, target: DataFrame, compare: list[str], keys: list[str],
                 s_explicit: set[str], t_explicit: set[str], auto_detect: bool = True) -> Profile:
    """Date columns and formats per side, number columns over both sides.

    ``source``/``target`` carry keys normalised once (the date profile input)."""
    sides = {"source": (source, s_explicit), "target": (target, t_explicit)}
    key_set = set(keys)

    def all_cells(columns: dict[str, list[str]]) -> DataFrame | None:
        parts = [_raw_cells(sides[s][0], cols, key_set, s) for s, cols in columns.items() if cols]
        return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None

    profiled = {s: list(dict.fromkeys([*compare, *sorted(explicit)])) for s, (_, explicit) in sides.items()}
    text = _by_column(text_counts(all_cells(profiled)))

    def detected(side: str, c: str) -> bool:
        r = text.get((side, c))
        return bool(r and r["nonsentinel"] and r["date_like"] >= enough(r["nonsentinel"]))

    dates = {s: [c for c in cols if c in sides[s][1] or (auto_detect and c in compare and detected(s, c))]
             for s, cols in profiled.items()}
    cells = all_cells(dates)
    formats = _by_column(format_counts(cells)) if cells is not None else {}

    decisions: dict[str, dict[str, DateDecision]] = {}
    for side, (_, explicit) in sides.items():
        decisions[side] = {}
        for c in profiled[side]:
            r, f = text.get((side, c)), formats.get((side, c))
            parses = tuple(f[f"parsed_{j}"] if f else 0 for j in range(len(FORMATS)))
            decisions[side][c] = DateDecision(c, r["nonsentinel"] if r else 0, r["date_like"] if r else 0, parses,
                                              c in explicit, c in dates[side], chosen_format(f))

    def compared(side: str, c: str) -> tuple[int, int, int]:
        """Number counters of the values that will be compared."""
        r, f, d = text.get((side, c)), formats.get((side, c)), decisions[side][c]
        if r is None:
            return 0, 0, 0
        if not d.is_date or f is None:
            return r["numbers_of"], r["castable"], r["with_dash"]
        if d.fmt is None:
            return f["f_numbers_of"], f["f_castable"], f["f_with_dash"]
        return f[f"exact_{FORMATS.index(d.fmt)}"], 0, 0      # yyyy/MM/dd: text without a dash

    numbers = {c: NumberDecision(c, *(a + b for a, b in zip(compared("source", c), compared("target", c)))) for c in compare}
    rows = sum(text[s, compare[0]]["rows"] for s in sides if compare and (s, compare[0]) in text)
    return Profile(decisions["source"], decisions["target"], numbers, rows)


def detect_dates(df: DataFrame, columns: list[str], explicit: set[str]) -> dict[str, DateDecision]:
    """Date decisions of one table."""
    empty = df.limit(0)
    return profile_both(df, empty, columns, [], explicit, set()).source_dates


# ---------------------------------------------------------------------------
# The same counters as tables
# ---------------------------------------------------------------------------

def date_profile_frame(df: DataFrame, columns: list[str], side: str, keys: list[str] = ()) -> DataFrame:
    """Per column: non-sentinel and date-like counts and the auto-detect verdict."""
    need = F.greatest(F.col("nonsentinel") * F.lit(DATE_SHARE), F.lit(1.0))
    return (text_counts(_raw_cells(df, columns, set(keys), side))
            .select("side", "column_name", "nonsentinel", "date_like",
                    ((F.col("nonsentinel") > 0) & (F.col("date_like") >= need)).alias("is_date")))


def date_format_frame(df: DataFrame, columns: list[str], side: str, keys: list[str] = ()) -> DataFrame:
    """Per column: parse count of every common format and the chosen format, null when none does."""
    need = F.greatest(F.col("nonsentinel") * F.lit(DATE_SHARE), F.lit(1.0))
    chosen = F.lit(None).cast("string")
    for j in reversed(range(len(FORMATS))):
        chosen = F.when((F.col("nonsentinel") > 0) & (F.col(f"parsed_{j}") >= need), F.lit(FORMATS[j].strftime)).otherwise(chosen)
    return (format_counts(_raw_cells(df, columns, set(keys), side))
            .select("side", "column_name", "nonsentinel", *[f"parsed_{j}" for j in range(len(FORMATS))],
                    chosen.alias("date_format")))


def numeric_profile_frame(profile: Profile, like: DataFrame) -> DataFrame:
    """Per compared column the pooled number counters and the verdict (one driver row per column)."""
    rows = [(d.column, d.nonsentinel, d.castable, d.with_dash, d.is_numeric) for d in profile.numbers.values()]
    return like.sparkSession.createDataFrame(
        rows, "column_name string, nonsentinel bigint, castable bigint, with_dash bigint, is_numeric boolean")
