"""Side preparation: string projection, renames, key and date normalisation,
composite key. All narrow projections — no shuffle, one codegen stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.functions.clean import composite_key, float_to_int_text, normalize_key
from tally.functions.dates import normalize_date
from tally.operators.names import q
from tally.operators.profile import DateDecision

KEY = "_key"


def stringify(df: DataFrame, scales: dict[str, int] | None = None) -> DataFrame:
    """Every column as text, header names trimmed.

    Floats and doubles are written out in full (5.0 → "5", no exponent), or with
    the places that ``scales`` gives for their name. Timestamps render as
    ``yyyy-MM-dd HH:mm:ss`` in the session's time zone: set UTC where both sides
    come from different zones.
    """
    scales = scales or {}
    cols = []
    for f in df.schema.fields:
        c, name = q(f.name), f.name.strip()
        if isinstance(f.dataType, T.StringType):
            out = c
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out = float_to_int_text(c)
            if name in scales:
                fixed = c.cast("string").try_cast(f"decimal(38,{scales[name]})").cast("string")
                out = F.coalesce(fixed, out)     # nan, inf and what does not fit keep their text
        else:
            out = c.cast("string")
        cols.append(out.alias(name))
    return df.select(*cols)


def rename(df: DataFrame, renames: list[tuple[str, str]]) -> DataFrame:
    """One projection applying (original → new) names."""
    by_trimmed = {f.name.strip(): f.name for f in df.schema.fields}
    return df.select(*[q(by_trimmed.get(old, old)).alias(new) for old, new in renames])


def normalize_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    present = [k for k in keys if k in df.columns]
    return df.withColumns({k: normalize_key(q(k)) for k in present}) if present else df


def normalize_dates(df: DataFrame, decisions: dict[str, DateDecision]) -> DataFrame:
    cols = {c: normalize_date(q(c), d.fmt) for c, d in decisions.items() if d.is_date and c in df.columns}
    return df.withColumns(cols) if cols else df


def add_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn(KEY, composite_key([q(k) for k in keys]))
