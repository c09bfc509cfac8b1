"""A few registered queries against their DuckDB oracle SQL at sf0.001
(the full set runs with tools/check_oracle.py at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as entry
from tally.plans.fixtures import TABLES

from paths import SF_SMALL

NAMES = ["clean_string", "clean_number", "normalize_dates_fallback", "detect_date_format",
         "summary", "summary_lines", "discrepancies_conv", "full_data", "paginate_report", "discrepancies_dups",
         "discrepancies_hot", "written_csv", "stringify_typed"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(v):
    return round(v, 6) if isinstance(v, float) and v == v else ("nan" if isinstance(v, float) else v)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    res = duck.execute(entry.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(d_cols)
    order = sorted(df.columns)
    s_rows = sorted((tuple(_norm(r[c]) for c in order) for r in df.collect()), key=repr)
    idx = [d_cols.index(c) for c in order]
    d_rows = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert s_rows == d_rows
