"""DuckDB SQL for the correctness oracle.

The same reconciliation rules written as plain SQL text over the fixture
views: profiling decisions are scalar subqueries, positions are
``row_number()``, pairing is a full outer join. Used only to check the Spark
queries; nothing here runs on Spark.
"""

from __future__ import annotations

from tally.functions import clean as C
from tally.functions import dates as DT
from tally.operators import profile as PR
from tally.plans.fixtures import FIXTURES, Fixture
from tally.spec import align


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ident(s: str) -> str:
    return '"' + s.replace('"', '""') + '"'


# -- scalar rules -------------------------------------------------------------
def blank(x: str) -> str:
    return f"coalesce(cast({x} as varchar), '')"


def squash(x: str) -> str:
    seps = C.separator_chars()
    y = f"translate({blank(x)}, {lit(seps + C.invisible_chars())}, {lit(' ' * len(seps))})"
    return f"trim(regexp_replace({y}, {lit(C.SPACE_RUN)}, ' ', 'g'))"


def clean_string(x: str, case_sensitive: bool = True) -> str:
    y = f"replace({squash(x)}, ',', '')"
    y = f"regexp_replace({y}, {lit(C.TRAILING_ZEROS)}, '')"
    y = f"trim(case when lower({y}) in ({', '.join(lit(v) for v in C.STRING_SENTINELS)}) then '' else {y} end)"
    return y if case_sensitive else f"lower({y})"


def guarded_double(y: str) -> str:
    return f"(case when regexp_matches({y}, {lit(C.NUMBER_SHAPE)}) then try_cast({y} as double) end)"


def clean_number(x: str) -> str:
    y = f"trim(replace(replace({squash(x)}, '%', ''), ',', ''))"
    return round_even4(guarded_double(y))


def round_even4(d: str) -> str:
    """Four places, ties to even; from 2^53 on there is nothing to round."""
    return f"(case when abs({d}) < 9007199254740992 then round_even({d} * 10000, 0) / 10000 else {d} end)"


def normalize_key(x: str) -> str:
    y = f"regexp_replace({squash(x)}, {lit(C.TRAILING_ZEROS)}, '')"
    return f"(case when {y} in ({', '.join(lit(v) for v in C.KEY_SENTINELS)}) then '' else {y} end)"


def composite_key(cols: list[str]) -> str:
    parts = [f"lower(translate({blank(c)}, {lit(C.white_space_chars())}, ''))" for c in cols]
    return f"concat_ws({lit(C.KEY_SEPARATOR)}, {', '.join(parts)})"


def float_to_int_text(x: str) -> str:
    """Shortest digits without exponent: the exponent moves the point in the digits."""
    t = f"cast({x} as varchar)"
    mantissa, power = f"split_part({t}, 'e', 1)", f"cast(split_part({t}, 'e', 2) as int)"
    sign = f"(case when starts_with({t}, '-') then '-' else '' end)"
    bare = f"ltrim({mantissa}, '-')"
    whole = f"split_part({bare}, '.', 1)"
    digits = f"({whole} || rtrim(split_part({bare}, '.', 2), '0'))"
    point = f"(length({whole}) + {power})"
    moved = (f"(case when {point} <= 0 then '0.' || repeat('0', -{point}) || {digits} "
             f"when {point} >= length({digits}) then {digits} || repeat('0', {point} - length({digits})) "
             f"else substr({digits}, 1, {point}) || '.' || substr({digits}, {point} + 1) end)")
    name = f"(case when isnan({x}) then 'NaN' when isinf({x}) then (case when {x} > 0 then 'Infinity' else '-Infinity' end) end)"
    return (f"(case when isnan({x}) or isinf({x}) then {name} when contains({t}, 'e') then {sign} || {moved} "
            f"else regexp_replace({t}, '[.]0$', '') end)")


def diff_numeric(a: str, b: str) -> str:
    return (f"(({a} is not null and {b} is not null and abs({a} - {b}) > {C.NUMERIC_TOLERANCE}) "
            f"or (({a} is null) <> ({b} is null)))")


def diff_string(a: str, b: str) -> str:
    return f"(coalesce({a}, '') <> coalesce({b}, ''))"


def py_strip(x: str) -> str:
    return f"trim({x}, {lit(DT.PY_SPACE_CHARS)})"


def sentinel(v: str, values) -> str:
    return f"({v} in ({', '.join(lit(s) for s in values)}))"


def date_like(v: str) -> str:
    return f"regexp_matches({v}, {lit(DT.DATE_LIKE)})"


def parse_with(v: str, fmt: DT.DateFormat) -> str:
    return f"(case when regexp_matches({v}, {lit(fmt.shape)}) then try_strptime({v}, {lit(fmt.strftime)}) end)"


def normalize_known(x: str, fmt: DT.DateFormat) -> str:
    return f"coalesce(strftime({parse_with(blank(x), fmt)}, '%Y/%m/%d'), '')"


def widen(t: str) -> str:
    p = lit(DT.TWO_DIGIT_YEAR)
    g = lambda i: f"regexp_extract({t}, {p}, {i})"
    return (f"(case when regexp_matches({t}, {p}) then {g(1)} || {g(2)} || {g(3)} || {g(4)} || "
            f"(case when {g(5)} < '69' then '20' else '19' end) || {g(5)} end)")


def normalize_fallback(x: str) -> str:
    t = blank(x)
    parses = [parse_with(widen(t) if f in DT.WIDENED else t, f) for f in DT.FALLBACK_FORMATS]
    return f"coalesce(strftime(coalesce({', '.join(parses)}), '%Y/%m/%d'), {t})"


def need(n: str) -> str:
    return f"greatest({n} * {DT.DATE_SHARE}, 1)"


# -- fixture plan -------------------------------------------------------------
class FixturePlan:
    """CTEs for one fixture: aligned, normalised and paired rows."""

    def __init__(self, fx: Fixture, with_pairs: bool = True):
        self.fx = fx
        self.p = fx.name
        self.al = align(fx.spec, list(fx.source_cols), list(fx.target_cols))
        self.spec = fx.spec

    # names of CTEs
    def n(self, suffix: str) -> str:
        return f"{self.p}_{suffix}"

    def side_ctes(self, side: str) -> list[str]:
        """raw → aligned+keys → profile → dates → keys → key column."""
        al, p = self.al, self.p
        raw_sql = self.fx.source_sql if side == "s" else self.fx.target_sql
        renames = al.source_renames if side == "s" else al.target_renames
        explicit = al.source_dates if side == "s" else al.target_dates
        cols = [n for _, n in renames]
        out = [f"{self.n(side + '_raw')} as ({raw_sql})"]
        sel = []
        for old, new in renames:
            e = ident(old)
            if new in al.keys:
                e = normalize_key(e)
            sel.append(f"{e} as {ident(new)}")
        out.append(f"{self.n(side + '_k1')} as (select {', '.join(sel)} from {self.n(side + '_raw')})")
        cand = list(dict.fromkeys([*sorted(explicit), *([c for c in al.compare if c not in explicit]
                                                        if self.spec.auto_detect_dates else [])]))
        self.__dict__[f"{side}_date_cols"] = cand
        aggs = []
        for i, c in enumerate(cand):
            v = py_strip(blank(ident(c)))
            real = f"not {sentinel(v, DT.DATE_SENTINELS)}"
            aggs.append(f"cast(count_if({real}) as bigint) as n{i}")
            aggs.append(f"cast(count_if({real} and {date_like(v)}) as bigint) as d{i}")
            for j, f in enumerate(DT.FORMATS):
                aggs.append(f"cast(count_if({real} and {parse_with(v, f)} is not null) as bigint) as p{i}_{j}")
        prof = self.n(side + "_dprof")
        if aggs:
            out.append(f"{prof} as (select {', '.join(aggs)} from {self.n(side + '_k1')})")
        sel = []
        for c in cols:
            e = ident(c)
            if c in cand:
                i = cand.index(c)
                sc = lambda name: f"(select {name} from {prof})"
                is_date = "true" if c in explicit else f"({sc(f'n{i}')} > 0 and {sc(f'd{i}')} >= {need(sc(f'n{i}'))})"
                branch = "case"
                for j, f in enumerate(DT.FORMATS):
                    branch += f" when {sc(f'n{i}')} > 0 and {sc(f'p{i}_{j}')} >= {need(sc(f'n{i}'))} then {normalize_known(e, f)}"
                branch += f" else {normalize_fallback(e)} end"
                e = f"(case when {is_date} then {branch} else {e} end)"
            if c in al.keys:
                e = normalize_key(e)
            sel.append(f"{e} as {ident(c)}")
        out.append(f"{self.n(side + '_n')} as (select {', '.join(sel)} from {self.n(side + '_k1')})")
        keyexpr = composite_key([ident(k) for k in al.keys])
        out.append(f"{self.n(side + '_key')} as (select *, {keyexpr} as _key from {self.n(side + '_n')})")
        return out

    def numeric_ctes(self) -> list[str]:
        cols = self.al.compare
        u = (f"select {', '.join(ident(c) for c in cols)} from {self.n('s_key')} union all "
             f"select {', '.join(ident(c) for c in cols)} from {self.n('t_key')}")
        aggs = []
        for i, c in enumerate(cols):
            v = ident(c)
            real = f"({v} is not null and not {sentinel(v, PR.NUMERIC_SENTINELS)})"
            stripped = f"regexp_replace({v}, '[%,]', '', 'g')"
            cast_ok = f"regexp_matches({stripped}, {lit(C.NUMBER_SHAPE)})"
            aggs += [f"cast(count_if({real}) as bigint) as t{i}", f"cast(count_if({real} and {cast_ok}) as bigint) as c{i}",
                     f"cast(count_if({real} and contains({v}, '-')) as bigint) as d{i}"]
        return [f"{self.n('nprof')} as (select {', '.join(aggs)} from ({u}) u)"]

    def is_numeric(self, c: str) -> str:
        i = self.al.compare.index(c)
        sc = lambda name: f"(select {name} from {self.n('nprof')})"
        return (f"coalesce({sc(f't{i}')} > 0 and {sc(f'c{i}')} / {sc(f't{i}')} >= {PR.NUMERIC_SHARE} "
                f"and {sc(f'd{i}')} / {sc(f't{i}')} < {PR.DASH_SHARE}, false)")

    def pair_ctes(self) -> list[str]:
        al = self.al
        s_cols, t_cols = al.source_columns, al.target_columns
        out = []
        for side, cols in (("s", s_cols), ("t", t_cols)):
            shown = dict.fromkeys([*al.order_by, *al.compare, *(al.context if side == "s" else [])])
            order = ", ".join(f"{ident(c)} asc nulls first" for c in shown)
            sel = ", ".join(f"{ident(c)} as {side}__{i}" for i, c in enumerate(cols))
            out.append(f"{self.n(side + '_rn')} as (select _key, row_number() over (partition by _key order by {order}) - 1 as _rn, "
                       f"{sel} from {self.n(side + '_key')})")
        out.append(f"{self.n('kc')} as (select _key, cast(sum(ns) as bigint) as ns, cast(sum(nt) as bigint) as nt from ("
                   f"select _key, count(*) as ns, 0 as nt from {self.n('s_key')} group by _key union all "
                   f"select _key, 0 as ns, count(*) as nt from {self.n('t_key')} group by _key) x group by _key)")
        s_sel = ", ".join(f"s.s__{i}" for i in range(len(s_cols)))
        t_sel = ", ".join(f"t.t__{i}" for i in range(len(t_cols)))
        status = ("case when s._key is not null and t._key is not null then 'MATCHED' "
                  "when s._key is not null and kc.nt = 0 then 'MISSING_IN_TARGET' "
                  "when s._key is not null then 'SURPLUS_IN_SOURCE' "
                  "when kc.ns = 0 then 'MISSING_IN_SOURCE' else 'SURPLUS_IN_TARGET' end")
        out.append(f"{self.n('paired')} as (select coalesce(s._key, t._key) as _key, coalesce(s._rn, t._rn) as _rn, kc.ns, kc.nt, "
                   f"s._key is not null as has_s, t._key is not null as has_t, {s_sel}, {t_sel}, {status} as status "
                   f"from {self.n('s_rn')} s full outer join {self.n('t_rn')} t on s._key = t._key and s._rn = t._rn "
                   f"join {self.n('kc')} kc on kc._key = coalesce(s._key, t._key))")
        flags = ", ".join(f"{self.flag(c)} as f__{i}" for i, c in enumerate(al.compare))
        out.append(f"{self.n('flags')} as (select *, {flags} from {self.n('paired')} where status = 'MATCHED')")
        return out

    def s(self, c: str) -> str:
        return f"s__{self.al.source_columns.index(c)}"

    def t(self, c: str) -> str:
        return f"t__{self.al.target_columns.index(c)}"

    def flag(self, c: str) -> str:
        cs = self.spec.case_sensitive
        num = diff_numeric(clean_number(self.s(c)), clean_number(self.t(c)))
        txt = diff_string(clean_string(self.s(c), cs), clean_string(self.t(c), cs))
        return f"(case when {self.is_numeric(c)} then {num} else {txt} end)"

    def f(self, c: str) -> str:
        return f"f__{self.al.compare.index(c)}"

    def ctes(self) -> list[str]:
        return self.side_ctes("s") + self.side_ctes("t") + self.numeric_ctes() + self.pair_ctes()

    def label(self, c: str) -> str:
        return self.al.label(c)

    # -- outputs ----------------------------------------------------------
    def cells_sql(self, internal: bool = False) -> str:
        sv, tv = self.spec.value_label
        parts = []
        for c in self.al.compare:
            ctx = ", ".join(f"{self.s(k)} as {ident(k)}" for k in self.al.context)
            extra = "_key, _rn, " if internal else ""
            parts.append(f"select {extra}{ctx}{', ' if ctx else ''}{lit(self.label(c))} as \"Column Name\", "
                         f"coalesce({self.s(c)}, '') as {ident(sv)}, coalesce({self.t(c)}, '') as {ident(tv)} "
                         f"from {self.n('flags')} where {self.f(c)}")
        return " union all ".join(parts)

    def summary_sql(self) -> str:
        S_, T_ = self.spec.source_label, self.spec.target_label
        pr = self.n("paired")
        fl = self.n("flags")
        any_flag = " or ".join(self.f(c) for c in self.al.compare)
        cnt = lambda cond, frm=pr: f"(select cast(count_if({cond}) as bigint) from {frm})"
        total = " + ".join(cnt(self.f(c), fl) for c in self.al.compare)
        missing_both = cnt("status in ('MISSING_IN_SOURCE', 'MISSING_IN_TARGET')")
        rows = [
            (1, f"{S_} Records Count", cnt("has_s")), (2, f"{T_} Records Count", cnt("has_t")),
            (3, "Matched Records", cnt("status = 'MATCHED'")),
            (4, f"Records Missing in {S_}", cnt("status = 'MISSING_IN_SOURCE'")),
            (5, f"Records Missing in {T_}", cnt("status = 'MISSING_IN_TARGET'")),
            (6, "Total Missing Records", cnt("status in ('MISSING_IN_SOURCE', 'MISSING_IN_TARGET')")),
            (7, f"Surplus Duplicates in {S_}", cnt("status = 'SURPLUS_IN_SOURCE'")),
            (8, f"Surplus Duplicates in {T_}", cnt("status = 'SURPLUS_IN_TARGET'")),
            (9, f"Duplicate Key Rows in {S_}", cnt("has_s and ns > 1")),
            (10, f"Duplicate Key Rows in {T_}", cnt("has_t and nt > 1")),
            (1000, "Unique Records with Discrepancies", cnt(any_flag, fl)),
            (1001, "Total Data Discrepancies (cell-level)", f"({total})"),
            (1002, "Total Validation Issues", f"({missing_both} + {total})"),
        ]
        fixed = " union all ".join(f"select cast({o} as bigint) as ordinal, {lit(m)} as metric, cast({v} as bigint) as value, "
                                   "cast(null as varchar) as text" for o, m, v in rows)
        names = [(-1, f"{S_} File", lit(self.spec.source_name)), (0, f"{T_} File", lit(self.spec.target_name)),
                 (1003, "Status", f"case when ({total}) = 0 then 'All mapped columns matched perfectly' else 'Discrepancies found' end")]
        fixed += "".join(f" union all select cast({o} as bigint), {lit(m)}, cast(null as bigint), {t}" for o, m, t in names)
        per = " union all ".join(f"select {lit(self.label(c))} as label, {cnt(self.f(c), fl)} as cnt" for c in self.al.compare)
        ranked = (f"select cast(99 + row_number() over (order by cnt desc, label) as bigint) as ordinal, "
                  f"'Discrepancies: ' || label as metric, cnt as value, cast(null as varchar) as text from ({per}) p where cnt > 0")
        return f"{fixed} union all {ranked}"

    def counts_sql(self) -> str:
        fl = self.n("flags")
        per = " union all ".join(f"select {lit(self.label(c))} as \"Column Name\", "
                                 f"(select cast(count_if({self.f(c)}) as bigint) from {fl}) as \"Count\"" for c in self.al.compare)
        return f"select * from ({per}) x where \"Count\" > 0"

    def missing_sql(self, status: str) -> str:
        if status == "MISSING_IN_TARGET":
            cols = ", ".join(f"{self.s(c)} as {ident(c)}" for c in self.al.source_columns)
        else:
            cols = ", ".join(f"{self.t(c)} as {ident(c)}" for c in self.al.target_columns)
        return f"select {cols} from {self.n('paired')} where status = {lit(status)}"

    def full_data_sql(self) -> str:
        sc = ", ".join(f"case when status in ('MATCHED', 'MISSING_IN_TARGET') then coalesce({self.s(c)}, '') else '' end as {ident(c + '_S')}"
                       for c in self.al.compare)
        tc = ", ".join(f"case when status in ('MATCHED', 'MISSING_IN_SOURCE') then coalesce({self.t(c)}, '') else '' end as {ident(c + '_T')}"
                       for c in self.al.compare)
        return (f"select {sc}, {tc}, status as \"Record Status\" from {self.n('paired')} "
                f"where status in ('MATCHED', 'MISSING_IN_TARGET', 'MISSING_IN_SOURCE')")

    def report_cols(self) -> list[str]:
        sv, tv = self.spec.value_label
        keys, inc = self.al.keys, self.al.include
        return [*keys, *[c for c in inc if c not in keys and c in self.al.context], "Column Name", sv, tv]

    def report_order(self) -> str:
        return ", ".join(['"Column Name"', *[ident(k) for k in self.al.keys], "_key", "_rn"])


def with_ctes(ctes: list[str], body: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + body


def fixture_sql(name: str, body_fn) -> str:
    plan = FixturePlan(FIXTURES[name])
    return with_ctes(plan.ctes(), body_fn(plan))
