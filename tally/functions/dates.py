"""Date detection and normalisation as built-in Spark expressions.

Each supported format carries three spellings, derived by rule from its
strftime form: the Spark datetime pattern, the DuckDB strptime format (for
the SQL oracle) and an anchored *shape* regex. A value is parsed only when it
has the exact shape, so both engines accept the same texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tally.functions.clean import blank_nulls, seldom

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference rules.
# ---------------------------------------------------------------------------
# Formats tried in this order; the first one that parses at least 60 % of the
# non-sentinel values of a column wins (so day-first beats month-first).
COMMON_DATE_FORMATS = [
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%d",
    "%Y/%m/%d",
    "%d-%m-%Y",
    "%d/%m/%Y",
    "%m/%d/%Y",
    "%m-%d-%Y",
    "%d-%m-%Y %H:%M:%S",
    "%d/%m/%Y %H:%M:%S",
    "%m/%d/%Y %H:%M:%S",
]
# "Looks like a date" test, each alternative anchored at the start:
# YYYY-M-D, D-M-YYYY, D-M-YY (then a non-word char or end), YYYYMMDD, ISO with time.
DATE_LIKE = (
    r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}"
    r"|^[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}"
    r"|^[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2}([^A-Za-z0-9_]|$)"
    r"|^[0-9]{4}[0-9]{2}[0-9]{2}$"
    r"|^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}[T ]"
)
# Values that count as "no value" when profiling dates.
DATE_SENTINELS = ["", "nan", "None", "NaN", "NaT"]
# Share of values that must match for detection / format choice.
DATE_SHARE = 0.6
# Output rendering of every normalised date.
OUTPUT_PATTERN = "yyyy/MM/dd"
# Characters Python's str.strip() removes (str.isspace): ASCII controls
# 09-0D and 1C-1F, then every Unicode space separator, line and paragraph sep.
PY_SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                  "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                  "\u2028\u2029\u202f\u205f\u3000")

_FIELD = {
    "%Y": ("yyyy", "[0-9]{4}"),
    "%m": ("M", "[0-9]{1,2}"),
    "%d": ("d", "[0-9]{1,2}"),
    "%H": ("H", "[0-9]{1,2}"),
    "%M": ("m", "[0-9]{1,2}"),
    "%S": ("s", "[0-9]{1,2}"),
    "%f": ("SSSSSS", "[0-9]{1,6}"),
}


@dataclass(frozen=True)
class DateFormat:
    strftime: str      # reference / DuckDB spelling
    spark: str         # Spark datetime pattern
    shape: str         # anchored regex the text must match before parsing


_FIXED = {"%m": ("MM", "[0-9]{2}"), "%d": ("dd", "[0-9]{2}"), "%H": ("HH", "[0-9]{2}"),
          "%M": ("mm", "[0-9]{2}"), "%S": ("ss", "[0-9]{2}")}


def _derive(fmt: str) -> DateFormat:
    """Spark pattern and shape regex from a strftime format. Fields written
    back to back (``%Y%m%d``) take fixed two-digit widths, others 1-2 digits."""
    toks = re.findall(r"%[A-Za-z]|.", fmt)
    spark, shape = [], ["^"]
    for i, tok in enumerate(toks):
        if tok in _FIELD:
            glued = any(0 <= j < len(toks) and toks[j] in _FIELD for j in (i - 1, i + 1))
            pat, rx = _FIXED[tok] if glued and tok in _FIXED else _FIELD[tok]
            spark.append(pat)
            shape.append(rx)
        else:
            spark.append(f"'{tok}'" if tok.isalpha() else tok)
            shape.append(re.escape(tok))
    shape.append("$")
    return DateFormat(fmt, "".join(spark), "".join(shape))


FORMATS: list[DateFormat] = [_derive(f) for f in COMMON_DATE_FORMATS]

# Fallback when no common format reaches the share: tried in order, each on
# its own shape; unparseable text is kept as it is. Two-digit years are
# widened first (00-68 → 20xx, 69-99 → 19xx) so every engine agrees.
FALLBACK_FORMATS: list[DateFormat] = [
    _derive("%Y%m%d"),
    _derive("%Y-%m-%d %H:%M:%S"),
    _derive("%Y-%m-%dT%H:%M:%S"),
    _derive("%Y-%m-%d %H:%M:%S.%f"),
    _derive("%Y-%m-%dT%H:%M:%S.%f"),
    _derive("%d-%m-%Y"),      # only for dd-mm-yy, after widening the year
    _derive("%d/%m/%Y"),      # only for dd/mm/yy, after widening the year
    _derive("%d.%m.%Y"),
]
WIDENED = (FALLBACK_FORMATS[5], FALLBACK_FORMATS[6])
TWO_DIGIT_YEAR = r"^([0-9]{2})([-/])([0-9]{2})([-/])([0-9]{2})$"


def py_strip(col: Column) -> Column:
    """``str.strip()`` semantics: trim every Python whitespace char (no regex)."""
    return F.btrim(col, F.lit(PY_SPACE_CHARS))


def is_sentinel(text: Column) -> Column:
    return text.isin(DATE_SENTINELS)


def date_like(text: Column) -> Column:
    """True when stripped text looks like a date (one of five shapes)."""
    return text.rlike(DATE_LIKE)


def parse_with(text: Column, fmt: DateFormat) -> Column:
    """Timestamp or null; parses only texts of the format's exact shape."""
    return F.when(text.rlike(fmt.shape), F.try_to_timestamp(text, F.lit(fmt.spark)))


# Fields of fixed width whose every value is valid, whatever the others are (days 29 to 31 are left to the parser).
_SURE = {"%Y": "[1-9][0-9]{3}", "%m": "(?:0[1-9]|1[0-2])", "%d": "(?:0[1-9]|1[0-9]|2[0-8])", "%H": "(?:[01][0-9]|2[0-3])",
         "%M": "[0-5][0-9]", "%S": "[0-5][0-9]"}


def _sure(text: Column, fmt: DateFormat) -> tuple[Column, Column]:
    """(text surely parses with the format, and its day as ``yyyy/MM/dd``, taken from its places)."""
    toks = re.findall(r"%[A-Za-z]|.", fmt.strftime)
    starts, at = {}, 1
    for tok in toks:
        starts[tok] = at
        at += 4 if tok == "%Y" else 2 if tok in _FIELD else 1
    shape = "^" + "".join(_SURE.get(tok) or re.escape(tok) for tok in toks) + r"\z"
    part = lambda tok, n: F.substring(text, starts[tok], n)
    # other zones leave out days, so there the parser decides
    return (text.rlike(shape) & (F.current_timezone() == "UTC"),
            F.concat(part("%Y", 4), F.lit("/"), part("%m", 2), F.lit("/"), part("%d", 2)))


def normalize_known(col: Column | str, fmt: DateFormat) -> Column:
    """Known format: parse, render ``yyyy/MM/dd``; unparseable → ``''``. Texts that surely parse are only taken apart."""
    text = blank_nulls(col)
    sure, day = _sure(text, fmt)
    parsed = lambda x: F.coalesce(F.date_format(parse_with(x, fmt), OUTPUT_PATTERN), F.lit(""))
    return F.when(sure, day).otherwise(seldom(text, parsed))


def widen_two_digit_year(text: Column) -> Column:
    yy = F.regexp_extract(text, TWO_DIGIT_YEAR, 5)
    century = F.when(yy < F.lit("69"), F.lit("20")).otherwise(F.lit("19"))
    return F.concat(F.regexp_extract(text, TWO_DIGIT_YEAR, 1), F.regexp_extract(text, TWO_DIGIT_YEAR, 2),
                    F.regexp_extract(text, TWO_DIGIT_YEAR, 3), F.regexp_extract(text, TWO_DIGIT_YEAR, 4),
                    century, yy)


def fallback_parse(col: Column | str) -> Column:
    """Timestamp from the first fallback format that parses, else null."""
    text = blank_nulls(col)
    wide = F.when(text.rlike(TWO_DIGIT_YEAR), widen_two_digit_year(text))
    return F.coalesce(*[parse_with(wide if f in WIDENED else text, f) for f in FALLBACK_FORMATS])


def normalize_fallback(col: Column | str) -> Column:
    """No format found: try the fallback list; unparseable keeps its text."""
    return F.coalesce(F.date_format(fallback_parse(col), OUTPUT_PATTERN), blank_nulls(col))


def normalize_date(col: Column | str, fmt: DateFormat | None) -> Column:
    return normalize_known(col, fmt) if fmt is not None else normalize_fallback(col)
