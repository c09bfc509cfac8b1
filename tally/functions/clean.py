"""Column-level cleaning rules (string, number, key) as built-in Spark expressions.

Every function takes and returns a ``Column`` so Catalyst can fold the whole
chain into one projection inside whole-stage codegen. No Python UDFs.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Patterns and sentinels that must equal the reference rules.
# ---------------------------------------------------------------------------
# Invisible format and control characters (Unicode categories Cf, Cc) are
# removed before spaces collapse; every other whitespace or separator
# character (categories Zs, Zl, Zp) becomes a space, and space runs collapse.
# The character tables are built by rule from the Unicode database (see
# ``invisible_chars`` / ``separator_chars``) and applied with ``translate``.
CONTROL_CATEGORIES = ("Cc", "Cf")
SEPARATOR_CATEGORIES = ("Zs", "Zl", "Zp")
SPACE_RUN = " {2,}"
# Trailing ".0", ".00", ... is dropped textually.
TRAILING_ZEROS = r"\.0+$"
# Text sentinels blanked by the string rule (any case): nan, none.
STRING_SENTINELS = ["nan", "none"]
# Text sentinels blanked by the key rule (exact spellings only).
KEY_SENTINELS = ["nan", "None", "NaN", "NaT"]
# Separator of the composite key.
KEY_SEPARATOR = "|"
# Text that a numeric cast may accept: plain decimal / exponent numbers, or
# nan / inf / infinity. Anything else is not a number on either engine.
NUMBER_SHAPE = r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:nan|[+-]?inf(inity)?))$"
# Numeric tolerance and rounding scale of the number rule.
NUMERIC_TOLERANCE = 0.0001
NUMERIC_SCALE = 4


@lru_cache(maxsize=None)
def _category_chars(categories: tuple[str, ...]) -> str:
    return "".join(ch for ch in map(chr, range(0x110000)) if unicodedata.category(ch) in categories)


def invisible_chars() -> str:
    """Every code point of category Cc or Cf (deleted)."""
    return _category_chars(CONTROL_CATEGORIES)


def separator_chars() -> str:
    """Every separator other than the plain space (mapped to a space)."""
    return _category_chars(SEPARATOR_CATEGORIES).replace(" ", "")


def white_space_chars() -> str:
    """Unicode White_Space: the whitespace the key rule removes."""
    return "".join(ch for ch in _category_chars(SEPARATOR_CATEGORIES + CONTROL_CATEGORIES)
                   if ch.isspace() and not "\x1c" <= ch <= "\x1f")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def blank_nulls(col: Column | str) -> Column:
    """Null becomes the empty string (the reference treats them as equal)."""
    return F.coalesce(_c(col).cast("string"), F.lit(""))


# Most values are plain: a rule that would leave a text as it is, is told by one pattern, and only other texts take
# the rule itself. The rule is then evaluated without generated code (``seldom``), which keeps the code of
# the usual way below the size that the JVM compiles.
#: Visible ASCII with single spaces inside: ``squash_spaces`` keeps it.
PLAIN = r"^(?:[!-~]++(?: [!-~]++)*+)?+\z"
#: The same without commas: only a trailing ``.0+`` or a sentinel is left to the string rule.
PLAIN_STRING = r"^(?:[!-+\--~]++(?: [!-+\--~]++)*+)?+\z"
#: Numbers with at most the places of the number rule, of which rounding gives the same double.
PLAIN_NUMBER = r"^-?+[0-9]{1,9}+(?:\.[0-9]{1,4}+)?+\z"
#: Visible ASCII: no whitespace to remove from a key.
NO_SPACES = r"^[!-~]*+\z"


def seldom(x: Column, rule) -> Column:
    """``rule(x)``, evaluated without generated code."""
    return F.transform(F.array(x), rule)[0]


def squash_spaces(col: Column | str) -> Column:
    """Drop control/format chars, turn separators into spaces, collapse space
    runs to one space, trim. One ``translate`` (a per-character table, no
    regex), for values that are not plain; the run collapse only runs on values that hold a double space."""
    x = blank_nulls(col)
    return F.when(x.rlike(PLAIN), x).otherwise(seldom(x, _squashed))


def _squashed(x: Column) -> Column:
    seps = separator_chars()
    x = F.translate(x, seps + invisible_chars(), " " * len(seps))
    x = F.when(x.contains("  "), F.regexp_replace(x, SPACE_RUN, " ")).otherwise(x)
    return F.trim(x)


def _may_end_in_zeros(x: Column) -> Column:
    """Whether ``drop_trailing_zeros`` may change it."""
    return x.endswith("0") & x.contains(".")


def drop_trailing_zeros(x: Column) -> Column:
    """Textual removal of a trailing ``.0+`` (regex only where it can match)."""
    return F.when(x.endswith("0") & x.contains("."), F.regexp_replace(x, TRAILING_ZEROS, "")).otherwise(x)


def clean_string(col: Column | str, case_sensitive: bool = True) -> Column:
    """String compare form: squash spaces, drop commas and a trailing ``.0+``,
    blank ``nan``/``none`` in any case, trim; lower-case when not case-sensitive."""
    x = blank_nulls(col)
    plain = x.rlike(PLAIN_STRING) & ~(_may_end_in_zeros(x) & x.rlike(TRAILING_ZEROS)) & ~x.rlike(f"^(?i:{'|'.join(STRING_SENTINELS)})$")
    return F.when(plain, x if case_sensitive else F.lower(x)).otherwise(seldom(x, lambda v: string_tail(_squashed(v), case_sensitive)))


def drop_char(x: Column, ch: str) -> Column:
    """Remove every ``ch`` (only values holding one are rewritten)."""
    return F.when(x.contains(ch), F.replace(x, F.lit(ch), F.lit(""))).otherwise(x)


def string_tail(squashed: Column, case_sensitive: bool = True) -> Column:
    """The string rule after ``squash_spaces``."""
    x = drop_trailing_zeros(drop_char(squashed, ","))
    x = F.when((F.length(x) <= 4) & F.lower(x).isin(*STRING_SENTINELS), F.lit("")).otherwise(x)
    x = F.trim(x)
    return x if case_sensitive else F.lower(x)


def number_tail(squashed: Column) -> Column:
    """The number rule after ``squash_spaces``."""
    x = F.trim(drop_char(drop_char(squashed, "%"), ","))
    return round_half_even(guarded_double(x), NUMERIC_SCALE)


def guarded_double(text: Column) -> Column:
    """Cast text to double only when it has a number's shape, else null.

    ``try_cast`` alone would accept Java float suffixes (``1d``) and hex
    floats; the shape guard keeps the accepted set identical across engines.
    """
    return F.when(text.rlike(NUMBER_SHAPE), text.try_cast("double"))


def clean_number(col: Column | str) -> Column:
    """Number compare form: squash spaces, drop ``%`` and ``,``, trim, cast
    (blank or garbage → null), round half-to-even to 4 places."""
    x = blank_nulls(col)
    return F.when(x.rlike(PLAIN_NUMBER), x.try_cast("double")).otherwise(seldom(x, lambda v: number_tail(_squashed(v))))


def round_half_even(x: Column, scale: int) -> Column:
    """Round a double to ``scale`` places, ties to even, in float arithmetic
    (scale, ``rint``, unscale): no per-value BigDecimal. Values from 2^53 on have
    no places to round and are kept, so scaling never overflows."""
    factor = float(10 ** scale)
    return F.when(F.abs(x) < F.lit(float(2 ** 53)), F.rint(x * F.lit(factor)) / F.lit(factor)).otherwise(x)


def normalize_key(col: Column | str) -> Column:
    """Key normalisation: squash spaces, drop a trailing ``.0+``, blank the
    exact sentinels nan/None/NaN/NaT. Commas and case are kept."""
    x = blank_nulls(col)
    plain = x.rlike(PLAIN) & ~_may_end_in_zeros(x) & ~x.isin(*KEY_SENTINELS)
    return F.when(plain, x).otherwise(seldom(x, _normalized_key))


def _normalized_key(x: Column) -> Column:
    x = drop_trailing_zeros(_squashed(x))
    return F.when(x.isin(*KEY_SENTINELS), F.lit("")).otherwise(x)


def key_part(col: Column | str) -> Column:
    """One composite-key component: no whitespace at all, lower case."""
    x = blank_nulls(col)
    return F.lower(F.when(x.rlike(NO_SPACES), x).otherwise(seldom(x, lambda v: F.translate(v, white_space_chars(), ""))))


def composite_key(cols: list[Column | str]) -> Column:
    """Join key components with a bar; nulls count as empty (not skipped)."""
    return F.concat_ws(KEY_SEPARATOR, *[key_part(c) for c in cols])


# Text of a floating-point number with an exponent, as the engine prints it.
EXPONENT_TEXT = r"^(-?)([0-9]+)[.]?([0-9]*)[eE]([-+]?[0-9]+)$"


def plain_number_text(text: Column) -> Column:
    """``1.5E-4`` as ``0.00015``: the digits moved by the exponent, nothing rounded."""
    part = lambda i: F.regexp_extract(text, EXPONENT_TEXT, i)
    zeros = lambda n: F.repeat(F.lit("0"), n)
    # digits and how many of them stand before the point, worked out once per value
    number = F.struct(part(1).alias("sign"), F.concat(part(2), F.regexp_replace(part(3), "0+$", "")).alias("digits"),
                      (F.length(part(2)) + part(4).try_cast("int")).alias("point"))

    def written(n: Column) -> Column:
        digits, point = n["digits"], n["point"]
        length = F.length(digits)
        return F.concat(n["sign"], F.when(point <= 0, F.concat(F.lit("0."), zeros(-point), digits))
                        .when(point >= length, F.concat(digits, zeros(point - length)))
                        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."),
                                            F.substring(digits, point + 1, length))))

    return F.when(text.rlike(EXPONENT_TEXT), F.transform(F.array(number), written)[0]).otherwise(text)


def float_to_int_text(col: Column | str) -> Column:
    """A float or double as plain text, from its own shortest digits: whole values lose the
    fraction (5.0 → "5"), others keep every digit and never an exponent; nan and inf keep their text."""
    return F.regexp_replace(plain_number_text(_c(col).cast("string")), r"[.]0$", "")


def diff_numeric(a: Column, b: Column) -> Column:
    """Numbers differ: both present and |a-b| > 0.0001, or exactly one null.

    NaN compares above every value, so NaN vs NaN (and inf vs inf) differ."""
    both = a.isNotNull() & b.isNotNull() & (F.abs(a - b) > F.lit(NUMERIC_TOLERANCE))
    return both | (a.isNull() != b.isNull())


def diff_string(a: Column, b: Column) -> Column:
    """Strings differ after cleaning (null counts as empty)."""
    return F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit(""))
