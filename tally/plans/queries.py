"""Named queries over the driver tables: Spark builders and DuckDB oracle SQL.

Every query reads whole driver tables (through the fixture SQL) so its work
grows with them. Each Spark builder takes ``(spark, sf_dir)`` and returns a
lazy DataFrame; its oracle is the same computation written in DuckDB SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.functions import clean as C
from tally.functions import dates as DT
from tally.operators import profile as PR
from tally.operators import report as R
from tally.operators.diff import COLUMN_NAME, src, tgt
from tally.operators.names import q
from tally.operators.normalize import KEY, add_key, normalize_keys, rename, stringify
from tally.operators.pair import RN, duplicate_key_counts, hot_keys_of, number_within_key
from tally.plans import oracle as O
from tally.plans.fixtures import FIXTURES, load, register_tables
from tally.plans.pipeline import ReconResult, aligned_sides, prepare, reconcile
from tally.session import scratch_path
from tally.sources.files import ROW_ORDER, scan_csv_strings, write_table

PAGE_ROWS = 500
TOP_N = 1000

Builder = Callable[[SparkSession, str], DataFrame]


def run(spark: SparkSession, sf_dir: str, name: str) -> ReconResult:
    s, t, fx = load(spark, sf_dir, name)
    return reconcile(s, t, fx.spec)


def fixture_side(spark: SparkSession, sf_dir: str, name: str, side: str) -> DataFrame:
    s, t, _ = load(spark, sf_dir, name)
    return s if side == "s" else t


def _cte(name: str, side: str) -> str:
    fx = FIXTURES[name]
    return f"{name}_{side} as ({fx.source_sql if side == 'src' else fx.target_sql})"


def _with(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------------------
# Scalar functions
# ---------------------------------------------------------------------------

def q_clean_string(spark, sf):
    t = fixture_side(spark, sf, "conv", "t")
    return t.select("conv_id", "turn", F.col("text").alias("raw"), C.clean_string("text").alias("cleaned"))


SQL_CLEAN_STRING = _with(_cte("conv", "tgt")) + (
    f"select conv_id, turn, text as raw, {O.clean_string('text')} as cleaned from conv_tgt")


def q_clean_string_ci(spark, sf):
    t = fixture_side(spark, sf, "orders", "t")
    return t.select("order_no", C.clean_string("order_status", False).alias("status_ci"),
                    C.clean_string("prio", False).alias("prio_ci"), C.clean_string("amount", False).alias("amount_ci"))


SQL_CLEAN_STRING_CI = _with(_cte("orders", "tgt")) + (
    f"select order_no, {O.clean_string('order_status', False)} as status_ci, {O.clean_string('prio', False)} as prio_ci, "
    f"{O.clean_string('amount', False)} as amount_ci from orders_tgt")


def q_clean_number(spark, sf):
    t = fixture_side(spark, sf, "events", "t")
    return t.select("event_id", F.col("value").alias("raw"), C.clean_number("value").alias("number"))


SQL_CLEAN_NUMBER = _with(_cte("events", "tgt")) + (
    f"select event_id, value as raw, {O.clean_number('value')} as number from events_tgt")


def q_normalize_keys(spark, sf):
    t = fixture_side(spark, sf, "orders", "t")
    return t.select(F.col("order_no").alias("raw"), C.normalize_key("order_no").alias("key"))


SQL_NORMALIZE_KEYS = _with(_cte("orders", "tgt")) + (
    f"select order_no as raw, {O.normalize_key('order_no')} as key from orders_tgt")


def q_composite_key(spark, sf):
    s = fixture_side(spark, sf, "lines", "s")
    return s.select("ok", "ln", "pk", C.composite_key(["ok", "ln"]).alias("_key"))


SQL_COMPOSITE_KEY = _with(_cte("lines", "src")) + (
    f"select ok, ln, pk, {O.composite_key(['ok', 'ln'])} as _key from lines_src")


def q_float_to_int_text(spark, sf):
    register_tables(spark, sf, ["lineitem"])
    li = spark.table("lineitem")
    return li.select(F.col("l_orderkey").cast("bigint").alias("l_orderkey"), F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                     C.float_to_int_text("l_quantity").alias("qty"), C.float_to_int_text("l_discount").alias("discount"),
                     C.float_to_int_text("l_tax").alias("tax"))


SQL_FLOAT_TO_INT_TEXT = (
    f"select cast(l_orderkey as bigint) as l_orderkey, cast(l_linenumber as bigint) as l_linenumber, "
    f"{O.float_to_int_text('l_quantity')} as qty, {O.float_to_int_text('l_discount')} as discount, "
    f"{O.float_to_int_text('l_tax')} as tax from lineitem")


def q_date_like(spark, sf):
    t = fixture_side(spark, sf, "orders", "t")
    v = DT.py_strip(C.blank_nulls("ordered_on"))
    o = DT.py_strip(C.blank_nulls("order_no"))
    return t.select("order_no", "ordered_on", DT.date_like(v).alias("date_like"), DT.date_like(o).alias("key_date_like"))


SQL_DATE_LIKE = _with(_cte("orders", "tgt")) + (
    f"select order_no, ordered_on, {O.date_like(O.py_strip(O.blank('ordered_on')))} as date_like, "
    f"{O.date_like(O.py_strip(O.blank('order_no')))} as key_date_like from orders_tgt")

_DMY = DT.FORMATS[5]   # %d/%m/%Y
_MDY = DT.FORMATS[6]   # %m/%d/%Y


def q_normalize_dates(spark, sf):
    t = fixture_side(spark, sf, "orders", "t")
    return t.select("order_no", "ordered_on", DT.normalize_known("ordered_on", _DMY).alias("day_first"),
                    DT.normalize_known("ordered_on", _MDY).alias("month_first"))


SQL_NORMALIZE_DATES = _with(_cte("orders", "tgt")) + (
    f"select order_no, ordered_on, {O.normalize_known('ordered_on', _DMY)} as day_first, "
    f"{O.normalize_known('ordered_on', _MDY)} as month_first from orders_tgt")


def q_normalize_dates_fallback(spark, sf):
    s = fixture_side(spark, sf, "events", "s")
    return s.select("event_id", "ts", DT.normalize_fallback("ts").alias("ts_norm"),
                    DT.normalize_fallback("value").alias("value_norm"))


SQL_NORMALIZE_DATES_FALLBACK = _with(_cte("events", "src")) + (
    f"select event_id, ts, {O.normalize_fallback('ts')} as ts_norm, {O.normalize_fallback('value')} as value_norm from events_src")


def _joined(spark, sf, name, keys):
    s, t, _ = load(spark, sf, name)
    return s.alias("s").join(t.alias("t"), keys)


def q_diff_numeric(spark, sf):
    j = _joined(spark, sf, "events", ["event_id"])
    a, b = C.clean_number(F.col("s.value")), C.clean_number(F.col("t.value"))
    return j.select("event_id", a.alias("source_number"), b.alias("target_number"), C.diff_numeric(a, b).alias("differs"))


SQL_DIFF_NUMERIC = _with(_cte("events", "src"), _cte("events", "tgt")) + (
    f"select s.event_id, {O.clean_number('s.value')} as source_number, {O.clean_number('t.value')} as target_number, "
    f"{O.diff_numeric(O.clean_number('s.value'), O.clean_number('t.value'))} as differs "
    f"from events_src s join events_tgt t on s.event_id = t.event_id")


def q_diff_string(spark, sf):
    j = _joined(spark, sf, "conv", ["conv_id", "turn"])
    flag = lambda c, cs: C.diff_string(C.clean_string(F.col(f"s.{c}"), cs), C.clean_string(F.col(f"t.{c}"), cs))
    return j.select("conv_id", "turn", flag("role", True).alias("role_differs"), flag("role", False).alias("role_differs_ci"),
                    flag("text", True).alias("text_differs"))


def _sql_flag(c, cs):
    return O.diff_string(O.clean_string(f"s.{c}", cs), O.clean_string(f"t.{c}", cs))


SQL_DIFF_STRING = _with(_cte("conv", "src"), _cte("conv", "tgt")) + (
    f"select s.conv_id, s.turn, {_sql_flag('role', True)} as role_differs, {_sql_flag('role', False)} as role_differs_ci, "
    f"{_sql_flag('text', True)} as text_differs from conv_src s join conv_tgt t on s.conv_id = t.conv_id and s.turn = t.turn")


# ---------------------------------------------------------------------------
# Profiling
# ---------------------------------------------------------------------------

def _aligned_keyed(spark, sf, name):
    """Both sides renamed and key-normalised (the frames profiling reads)."""
    s, t, fx = load(spark, sf, name)
    al, s, t = aligned_sides(s, t, fx.spec)
    return s, t, al


def q_detect_date_columns(spark, sf):
    s, t, al = _aligned_keyed(spark, sf, "orders")
    return (PR.date_profile_frame(s, al.compare, "source", al.keys)
            .unionByName(PR.date_profile_frame(t, al.compare, "target", al.keys)))


def _sql_date_cols(plan: O.FixturePlan, side: str, side_name: str) -> str:
    parts = []
    for c in plan.al.compare:
        v = O.py_strip(O.blank(O.ident(c)))
        real = f"not {O.sentinel(v, DT.DATE_SENTINELS)}"
        parts.append(f"select {O.lit(side_name)} as side, {O.lit(c)} as column_name, cast(count_if({real}) as bigint) as nonsentinel, "
                     f"cast(count_if({real} and {O.date_like(v)}) as bigint) as date_like from {plan.n(side + '_k1')}")
    body = " union all ".join(parts)
    return (f"select side, column_name, nonsentinel, date_like, (nonsentinel > 0 and date_like >= {O.need('nonsentinel')}) as is_date "
            f"from ({body}) x")


def sql_detect_date_columns() -> str:
    plan = O.FixturePlan(FIXTURES["orders"])
    ctes = plan.side_ctes("s") + plan.side_ctes("t")
    return O.with_ctes(ctes, _sql_date_cols(plan, "s", "source") + " union all " + _sql_date_cols(plan, "t", "target"))


def q_detect_date_format(spark, sf):
    s, t, al = _aligned_keyed(spark, sf, "orders")
    return (PR.date_format_frame(s, al.compare, "source", al.keys)
            .unionByName(PR.date_format_frame(t, al.compare, "target", al.keys)))


def _sql_date_fmt(plan: O.FixturePlan, side: str, side_name: str) -> str:
    parts = []
    for c in plan.al.compare:
        v = O.py_strip(O.blank(O.ident(c)))
        real = f"not {O.sentinel(v, DT.DATE_SENTINELS)}"
        counts = ", ".join(f"cast(count_if({real} and {O.parse_with(v, f)} is not null) as bigint) as parsed_{j}"
                           for j, f in enumerate(DT.FORMATS))
        parts.append(f"select {O.lit(side_name)} as side, {O.lit(c)} as column_name, cast(count_if({real}) as bigint) as nonsentinel, "
                     f"{counts} from {plan.n(side + '_k1')}")
    chosen = "case" + "".join(f" when nonsentinel > 0 and parsed_{j} >= {O.need('nonsentinel')} then {O.lit(f.strftime)}"
                              for j, f in enumerate(DT.FORMATS)) + " end"
    cols = ", ".join(f"parsed_{j}" for j in range(len(DT.FORMATS)))
    return f"select side, column_name, nonsentinel, {cols}, {chosen} as date_format from ({' union all '.join(parts)}) x"


def sql_detect_date_format() -> str:
    plan = O.FixturePlan(FIXTURES["orders"])
    ctes = plan.side_ctes("s") + plan.side_ctes("t")
    return O.with_ctes(ctes, _sql_date_fmt(plan, "s", "source") + " union all " + _sql_date_fmt(plan, "t", "target"))


def q_detect_numeric_columns(spark, sf):
    out = None
    for name in ("orders", "cust"):
        s, t, fx = load(spark, sf, name)
        df = PR.numeric_profile_frame(prepare(s, t, fx.spec).profile, s).select(F.lit(name).alias("fixture"), "*")
        out = df if out is None else out.unionByName(df)
    return out


def sql_detect_numeric_columns() -> str:
    ctes, bodies = [], []
    for name in ("orders", "cust"):
        plan = O.FixturePlan(FIXTURES[name])
        ctes += plan.side_ctes("s") + plan.side_ctes("t") + plan.numeric_ctes()
        for i, c in enumerate(plan.al.compare):
            sc = lambda n: f"(select {n} from {plan.n('nprof')})"
            bodies.append(f"select {O.lit(name)} as fixture, {O.lit(c)} as column_name, {sc(f't{i}')} as nonsentinel, "
                          f"{sc(f'c{i}')} as castable, {sc(f'd{i}')} as with_dash, {plan.is_numeric(c)} as is_numeric")
    return O.with_ctes(ctes, " union all ".join(bodies))


def q_duplicate_keys(spark, sf):
    s, t, fx = load(spark, sf, "lines")
    keys = list(fx.spec.key_columns)
    count = lambda name, df: (duplicate_key_counts(add_key(normalize_keys(df, keys), keys))
                              .select(F.lit(name).alias("side"), "*"))
    return count("source", s).unionByName(count("target", t))


def sql_duplicate_keys() -> str:
    plan = O.FixturePlan(FIXTURES["lines"])
    ctes = plan.side_ctes("s") + plan.side_ctes("t")
    body = " union all ".join(
        f"select {O.lit(n)} as side, cast(sum(c) as bigint) as rows, cast(coalesce(sum(case when c > 1 then c end), 0) as bigint) as duplicate_rows, "
        f"cast(count_if(c > 1) as bigint) as duplicate_keys from (select _key, count(*) as c from {plan.n(sd + '_key')} group by _key) x"
        for sd, n in (("s", "source"), ("t", "target")))
    return O.with_ctes(ctes, body)


# ---------------------------------------------------------------------------
# Keys, joins, diff
# ---------------------------------------------------------------------------

def q_positional_keys(spark, sf):
    s, t, fx = load(spark, sf, "lines")
    keys = list(fx.spec.key_columns)
    k = add_key(normalize_keys(s, keys), keys)
    order = [F.col(c).asc_nulls_first() for c in fx.spec.order_by]
    return number_within_key(k, order, hot_keys_of(k, k.count())).select(KEY, RN, "ok", "ln", "pk", "sk", "price")


def sql_positional_keys() -> str:
    plan = O.FixturePlan(FIXTURES["lines"])
    return O.with_ctes(plan.side_ctes("s"), (
        f"select _key, cast(row_number() over (partition by _key order by pk asc nulls first, sk asc nulls first, price asc nulls first) - 1 as bigint) as _rn, "
        f"ok, ln, pk, sk, price from {plan.n('s_key')}"))


def _pair_cols(r: ReconResult, internal=True):
    al = r.al
    return ([F.col(KEY), F.col(RN).cast("bigint").alias(RN)] if internal else []) + \
        [src(c).alias(f"{c}_S") for c in al.compare] + [tgt(c).alias(f"{c}_T") for c in al.compare]


def _sql_pair_cols(plan: O.FixturePlan, internal=True) -> str:
    cols = (["_key", "cast(_rn as bigint) as _rn"] if internal else []) + \
        [f"{plan.s(c)} as {O.ident(c + '_S')}" for c in plan.al.compare] + [f"{plan.t(c)} as {O.ident(c + '_T')}" for c in plan.al.compare]
    return ", ".join(cols)


def q_matched_rows(spark, sf):
    r = run(spark, sf, "lines")
    return r.paired.where(F.col("_status") == "MATCHED").select(*_pair_cols(r))


def sql_matched_rows() -> str:
    return O.fixture_sql("lines", lambda p: f"select {_sql_pair_cols(p)} from {p.n('paired')} where status = 'MATCHED'")


def q_matched_keys(spark, sf):
    r = run(spark, sf, "orders")
    return r.paired.where(F.col("_status") == "MATCHED").select(KEY).distinct()


def sql_matched_keys() -> str:
    return O.fixture_sql("orders", lambda p: f"select distinct _key from {p.n('paired')} where status = 'MATCHED'")


def q_diff_flags(spark, sf):
    r = run(spark, sf, "orders")
    fl = r.flags()
    return fl.select(KEY, F.col(RN).cast("bigint").alias(RN), *[F.col(f"`__diff_{c}`") for c in r.al.compare])


def sql_diff_flags() -> str:
    return O.fixture_sql("orders", lambda p: "select _key, cast(_rn as bigint) as _rn, " + ", ".join(
        f"{p.f(c)} as {O.ident('__diff_' + c)}" for c in p.al.compare) + f" from {p.n('flags')}")


def q_columns_with_diffs(spark, sf):
    return run(spark, sf, "orders").columns_with_diffs()


def sql_columns_with_diffs() -> str:
    return O.fixture_sql("orders", lambda p: " union all ".join(
        f"select {O.lit(c)} as column_name where exists (select 1 from {p.n('flags')} where {p.f(c)})" for c in p.al.compare))


def q_mismatched_rows(spark, sf):
    r = run(spark, sf, "orders")
    return r.mismatched().select(*_pair_cols(r))


def sql_mismatched_rows() -> str:
    return O.fixture_sql("orders", lambda p: f"select {_sql_pair_cols(p)} from {p.n('flags')} where " +
                         " or ".join(p.f(c) for c in p.al.compare))


def _q_discrepancies(name):
    return lambda spark, sf: run(spark, sf, name).discrepancies()


def _sql_discrepancies(name):
    return O.fixture_sql(name, lambda p: p.cells_sql())


def _q_summary(name):
    return lambda spark, sf: run(spark, sf, name).summary()


def _sql_summary(name):
    return O.fixture_sql(name, lambda p: p.summary_sql())


def _q_missing(name, side):
    return lambda spark, sf: (run(spark, sf, name).missing_in_target() if side == "target"
                              else run(spark, sf, name).missing_in_source())


def _sql_missing(name, side):
    status = "MISSING_IN_TARGET" if side == "target" else "MISSING_IN_SOURCE"
    return O.fixture_sql(name, lambda p: p.missing_sql(status))


def q_full_data(spark, sf):
    return run(spark, sf, "orders").full_data()


def sql_full_data() -> str:
    return O.fixture_sql("orders", lambda p: p.full_data_sql())


def q_discrepancy_counts(spark, sf):
    return run(spark, sf, "orders").column_counts()


def sql_discrepancy_counts() -> str:
    return O.fixture_sql("orders", lambda p: p.counts_sql())


# ---------------------------------------------------------------------------
# Report, sinks, sources
# ---------------------------------------------------------------------------

def q_report_discrepancies(spark, sf):
    return run(spark, sf, "orders").report()


def _sql_report_body(p: O.FixturePlan, extra: str = "", limit: str = "") -> str:
    cols = ", ".join(O.ident(c) for c in p.report_cols())
    comments = "".join(f", '' as {O.ident(c)}" for c in p.spec.comment_columns)
    return f"select {cols}{extra}{comments} from ({p.cells_sql(internal=True)}) c order by {p.report_order()}{limit}"


def sql_report_discrepancies() -> str:
    return O.fixture_sql("orders", lambda p: _sql_report_body(p))


def q_report_top_n(spark, sf):
    return run(spark, sf, "orders").top_n(TOP_N)


def sql_report_top_n() -> str:
    return O.fixture_sql("orders", lambda p: _sql_report_body(p, limit=f" limit {TOP_N}"))


def q_paginate_report(spark, sf):
    return run(spark, sf, "orders").pages(PAGE_ROWS)


def sql_paginate_report() -> str:
    def body(p):
        cols = ", ".join(O.ident(c) for c in p.report_cols())
        return (f"select {cols}, cast(floor((row_number() over (order by {p.report_order()}) - 1) / {PAGE_ROWS}) + 1 as bigint) as page "
                f"from ({p.cells_sql(internal=True)}) c")
    return O.fixture_sql("orders", body)


def q_align_columns(spark, sf):
    s, t, fx = load(spark, sf, "orders")
    from tally.spec import align
    al = align(fx.spec, s.columns, t.columns)
    return rename(t, al.target_renames)


def sql_align_columns() -> str:
    plan = O.FixturePlan(FIXTURES["orders"])
    cols = ", ".join(f"{O.ident(o)} as {O.ident(n)}" for o, n in plan.al.target_renames)
    return _with(_cte("orders", "tgt")) + f"select {cols} from orders_tgt"


# lineitem's doubles as they are, divided (many digits), scaled far down (exponents), large whole ones, as 32-bit floats, and NaN.
TYPED_SQL = """select l_orderkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag, l_discount / 3 as third,
  l_partkey * cast(1e17 as double) as large, l_extendedprice / 1e12 as tiny, cast(l_tax as float) as tax32,
  case when l_partkey%50=0 then cast('NaN' as double) else l_discount end as odd, l_extendedprice as fixed from lineitem"""


def q_stringify_typed(spark, sf):
    register_tables(spark, sf, ["lineitem"])
    return stringify(spark.sql(TYPED_SQL), {"fixed": 1})


SQL_STRINGIFY_TYPED = (
    "select cast(l_orderkey as varchar) as l_orderkey, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as l_shipdate, l_returnflag, "
    + ", ".join(f"{O.float_to_int_text(c)} as {c}" for c in ("l_quantity", "l_extendedprice", "third", "large", "tiny", "tax32", "odd"))
    + f", cast(cast(cast(fixed as varchar) as decimal(38,1)) as varchar) as fixed from ({TYPED_SQL}) x")


def q_written_csv(spark, sf):
    """The `texts` discrepancies written as CSV by the sink and read back with the all-string scan."""
    out = run(spark, sf, "texts").write(scratch_path(spark, f"csv-{uuid.uuid4().hex}"), fmt="csv")
    return scan_csv_strings(spark, out.paths["discrepancies"])


def sql_written_csv() -> str:
    def body(p):
        cols = ", ".join(f"nullif({O.ident(c)}, '') as {O.ident(c)}" for c in p.report_cols())
        comments = "".join(f", cast(null as varchar) as {O.ident(c)}" for c in p.spec.comment_columns)
        return f"select {cols}{comments} from ({p.cells_sql(internal=True)}) c"
    return O.fixture_sql("texts", body)


HOT_ROWS = 1000  # rows above which the `hot` fixture's key takes the range path


def _hot(spark, sf) -> ReconResult:
    s, t, fx = load(spark, sf, "hot")
    return reconcile(s, t, fx.spec, hot_key_rows=HOT_ROWS)


def q_summary_hot(spark, sf):
    return _hot(spark, sf).summary()


def q_discrepancies_hot(spark, sf):
    return _hot(spark, sf).discrepancies()


def _runs(spark, sf) -> ReconResult:
    s, t, fx = load(spark, sf, "runs")
    return reconcile(s, t, fx.spec, hot_key_rows=HOT_ROWS)


def q_summary_runs(spark, sf):
    return _runs(spark, sf).summary()


def q_discrepancies_runs(spark, sf):
    return _runs(spark, sf).discrepancies()


def files_in_order(spark, sf) -> ReconResult:
    """Both sides of `files` written as CSV in the order of ``ord``, without it; read back in splits and paired in file order."""
    s, t, fx = load(spark, sf, "files")

    def written(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, f"csv-files-{uuid.uuid4().hex}")
        write_table(df.orderBy("ord").drop("ord"), path, "csv")
        rows = scan_csv_strings(spark, path, row_order=True)
        kept = scratch_path(spark, f"rows-files-{uuid.uuid4().hex}")      # parsed once: a comparison reads its sides several times
        write_table(rows, kept)
        return spark.read.schema(rows.schema).parquet(kept)

    return reconcile(written(s), written(t), replace(fx.spec, order_by=(ROW_ORDER,)))


def q_discrepancies_files(spark, sf):
    return files_in_order(spark, sf).discrepancies()


def q_summary_files(spark, sf):
    return files_in_order(spark, sf).summary()


def q_uncastable_numbers(spark, sf):
    return run(spark, sf, "events").uncastable().unionByName(run(spark, sf, "orders").uncastable())


def sql_uncastable_numbers() -> str:
    ctes, parts = [], []
    for name in ("events", "orders"):
        p = O.FixturePlan(FIXTURES[name])
        ctes += p.side_ctes("s") + p.side_ctes("t") + p.numeric_ctes()
        parts += [f"select {O.lit(c)} as column_name, (select t{i} from {p.n('nprof')}) as nonsentinel, "
                  f"(select t{i} - c{i} from {p.n('nprof')}) as uncastable where {p.is_numeric(c)}" for i, c in enumerate(p.al.compare)]
    return O.with_ctes(ctes, " union all ".join(parts))


def q_top_n_of_many(spark, sf):
    """The first half of the `conv` cells, found by narrowing beginnings instead of sorting all cells."""
    r = run(spark, sf, "conv").materialize()
    half = sum(n for c, n in r.counted.items() if c != "records_affected") // 2
    keep = R.first_rows(r.cells(), [COLUMN_NAME, *r.al.keys, KEY], half, 0)
    return r.cells().where(keep).drop(KEY, RN)


def sql_top_n_of_many() -> str:
    def body(p):
        cols = ", ".join(O.ident(c) for c in p.report_cols())
        order = ", ".join(['"Column Name"', *[O.ident(k) for k in p.al.keys], "_key"])
        return (f"select {cols} from (select *, rank() over (order by {order}) as r, count(*) over () as n "
                f"from ({p.cells_sql(internal=True)}) c) x where r <= n // 2")
    return O.fixture_sql("conv", body)


def q_page_files(spark, sf):
    """The `orders` report written in files of ``PAGE_ROWS`` rows and read back: every row with its file's number and size."""
    path = scratch_path(spark, f"pages-{uuid.uuid4().hex}")
    r = run(spark, sf, "orders").materialize()
    r.write_pages(path, PAGE_ROWS)
    rows = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_name"))
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("file_rows"))
    name = lambda i: F.regexp_extract("file", "^part-([0-9]+)-.*-c([0-9]+)", i).cast("bigint")
    number = (name(1) * r.pages_of_a_task(PAGE_ROWS) + name(2) + 1).alias("page")
    return rows.join(files, "file").select(*[q(c) for c in rows.columns if c != "file"], number, "file_rows")


def sql_page_files() -> str:
    def body(p):
        cols = ", ".join(O.ident(c) for c in p.report_cols())
        comments = "".join(f", '' as {O.ident(c)}" for c in p.spec.comment_columns)
        return (f"select *, count(*) over (partition by page) as file_rows from (select {cols}{comments}, "
                f"cast(floor((row_number() over (order by {p.report_order()}) - 1) / {PAGE_ROWS}) + 1 as bigint) as page "
                f"from ({p.cells_sql(internal=True)}) c) x")
    return O.fixture_sql("orders", body)


def q_scan_csv_strings(spark, sf):
    """Write the orders target fixture as CSV (shared scratch folder), read it
    back with the all-string scan."""
    t = fixture_side(spark, sf, "orders", "t")
    path = scratch_path(spark, f"csv-orders-tgt-{uuid.uuid4().hex[:12]}")
    (t.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return scan_csv_strings(spark, path)


SQL_SCAN_CSV_STRINGS = _with(_cte("orders", "tgt")) + (
    "select nullif(order_no, '') as order_no, nullif(cust_no, '') as cust_no, nullif(order_status, '') as order_status, "
    "nullif(amount, '') as amount, nullif(ordered_on, '') as ordered_on, nullif(prio, '') as prio from orders_tgt")


# ---------------------------------------------------------------------------
# Registry
# ---------------------------------------------------------------------------

def registry() -> dict[str, tuple[Builder, Callable[[], str] | str]]:
    reg: dict[str, tuple[Builder, Callable[[], str] | str]] = {
        "clean_string": (q_clean_string, SQL_CLEAN_STRING),
        "clean_string_ci": (q_clean_string_ci, SQL_CLEAN_STRING_CI),
        "clean_number": (q_clean_number, SQL_CLEAN_NUMBER),
        "normalize_keys": (q_normalize_keys, SQL_NORMALIZE_KEYS),
        "composite_key": (q_composite_key, SQL_COMPOSITE_KEY),
        "float_to_int_text": (q_float_to_int_text, SQL_FLOAT_TO_INT_TEXT),
        "date_like": (q_date_like, SQL_DATE_LIKE),
        "normalize_dates": (q_normalize_dates, SQL_NORMALIZE_DATES),
        "normalize_dates_fallback": (q_normalize_dates_fallback, SQL_NORMALIZE_DATES_FALLBACK),
        "diff_numeric": (q_diff_numeric, SQL_DIFF_NUMERIC),
        "diff_string": (q_diff_string, SQL_DIFF_STRING),
        "detect_date_columns": (q_detect_date_columns, sql_detect_date_columns),
        "detect_date_format": (q_detect_date_format, sql_detect_date_format),
        "detect_numeric_columns": (q_detect_numeric_columns, sql_detect_numeric_columns),
        "duplicate_keys": (q_duplicate_keys, sql_duplicate_keys),
        "positional_keys": (q_positional_keys, sql_positional_keys),
        "matched_rows": (q_matched_rows, sql_matched_rows),
        "matched_keys": (q_matched_keys, sql_matched_keys),
        "diff_flags": (q_diff_flags, sql_diff_flags),
        "columns_with_diffs": (q_columns_with_diffs, sql_columns_with_diffs),
        "mismatched_rows": (q_mismatched_rows, sql_mismatched_rows),
        "discrepancies": (_q_discrepancies("orders"), lambda: _sql_discrepancies("orders")),
        "missing_in_target": (_q_missing("orders", "target"), lambda: _sql_missing("orders", "target")),
        "missing_in_source": (_q_missing("orders", "source"), lambda: _sql_missing("orders", "source")),
        "full_data": (q_full_data, sql_full_data),
        "discrepancy_counts": (q_discrepancy_counts, sql_discrepancy_counts),
        "summary": (_q_summary("orders"), lambda: _sql_summary("orders")),
        "report_discrepancies": (q_report_discrepancies, sql_report_discrepancies),
        "report_top_n": (q_report_top_n, sql_report_top_n),
        "paginate_report": (q_paginate_report, sql_paginate_report),
        "align_columns": (q_align_columns, sql_align_columns),
        "stringify_typed": (q_stringify_typed, SQL_STRINGIFY_TYPED),
        "scan_csv_strings": (q_scan_csv_strings, SQL_SCAN_CSV_STRINGS),
        "written_csv": (q_written_csv, sql_written_csv),
        "summary_hot": (q_summary_hot, lambda: _sql_summary("hot")),
        "discrepancies_hot": (q_discrepancies_hot, lambda: _sql_discrepancies("hot")),
        "summary_runs": (q_summary_runs, lambda: _sql_summary("runs")),
        "discrepancies_runs": (q_discrepancies_runs, lambda: _sql_discrepancies("runs")),
        "summary_files": (q_summary_files, lambda: _sql_summary("files")),
        "discrepancies_files": (q_discrepancies_files, lambda: _sql_discrepancies("files")),
        "page_files": (q_page_files, sql_page_files),
        "top_n_of_many": (q_top_n_of_many, sql_top_n_of_many),
        "uncastable_numbers": (q_uncastable_numbers, sql_uncastable_numbers),
    }
    for name in ("lines", "cust", "conv", "events", "dups"):
        reg[f"discrepancies_{name}"] = (_q_discrepancies(name), (lambda n=name: _sql_discrepancies(n)))
        reg[f"summary_{name}"] = (_q_summary(name), (lambda n=name: _sql_summary(n)))
    reg["missing_in_target_lines"] = (_q_missing("lines", "target"), lambda: _sql_missing("lines", "target"))
    reg["missing_in_target_conv"] = (_q_missing("conv", "target"), lambda: _sql_missing("conv", "target"))
    return reg


def queries() -> dict[str, Builder]:
    return {k: v[0] for k, v in registry().items()}


def oracle_sql() -> dict[str, str]:
    return {k: (v[1]() if callable(v[1]) else v[1]) for k, v in registry().items()}
