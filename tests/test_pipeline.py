"""End-to-end reconciliation: fixture counts (FIXTURES.md), edge fixtures,
invariants, and the skew path producing the same rows as the plain path."""

import pytest
from pyspark.sql import functions as F

from tally import ReconSpec, reconcile
from tally.plans.fixtures import load

from paths import SF_CHECK, SF_SMALL

# Expected counts at sf0.01 (FIXTURES.md §2): src, tgt, matched, missing in
# target, missing in source, surplus src, per-column counts, total, affected.
CUST_DIFFS = 1480
EXPECTED = {
    "orders": (14851, 14854, 14707, 144, 147, 0,
               {"status - order_status": 1131, "total - amount": 314, "order_date - ordered_on": 507, "priority - prio": 1381}, 3333, 3079),
    "lines": (60000, 59363, 59363, 377, 0, 260, {"pk - pk": 175, "sk - sk": 174, "qty - qty": 1253, "price - price": 175, "rf - rf": 2484}, 4261, 3569),
    "cust": (1500, 1500, 1500, 0, 0, 0, {"bal - bal": CUST_DIFFS}, CUST_DIFFS, CUST_DIFFS),
    "conv": (536, 528, 528, 8, 0, 0, {"role - role": 528, "text - text": 38}, 566, 528),
    "events": (10000, 10000, 10000, 0, 0, 0, {"ts - ts": 271}, 271, 271),
}


def summary_map(result):
    return {r.metric: r.value for r in result.summary().collect() if r.value is not None}


@pytest.mark.parametrize("name", list(EXPECTED))
def test_fixture_counts(spark, name):
    s, t, fx = load(spark, SF_CHECK, name)
    r = reconcile(s, t, fx.spec)
    m = summary_map(r)
    src, tgt, matched, miss_t, miss_s, sur_s, per_col, total, affected = EXPECTED[name]
    assert m["Source Records Count"] == src and m["Target Records Count"] == tgt
    assert m["Matched Records"] == matched
    assert m["Records Missing in Target"] == miss_t and m["Records Missing in Source"] == miss_s
    assert m["Surplus Duplicates in Source"] == sur_s
    assert {k[len("Discrepancies: "):]: v for k, v in m.items() if k.startswith("Discrepancies: ")} == per_col
    assert m["Total Data Discrepancies (cell-level)"] == total
    assert m["Unique Records with Discrepancies"] == affected
    # rows always add up: matched + missing + surplus = side rows
    assert matched + miss_t + m["Surplus Duplicates in Source"] == src
    assert matched + miss_s + m["Surplus Duplicates in Target"] == tgt


def test_case_insensitive_orders(spark):
    s, t, fx = load(spark, SF_CHECK, "orders")
    from dataclasses import replace
    m = summary_map(reconcile(s, t, replace(fx.spec, case_sensitive=False)))
    assert "Discrepancies: status - order_status" not in m


def test_selftest(spark):
    src = spark.createDataFrame([("1", "1000"), ("2", "2000"), ("3", "")], "EmpID string, Salary string")
    tgt = spark.createDataFrame([("1", "1000"), ("2", "2500"), ("3", "")], "EmpID string, Pay string")
    spec = ReconSpec(mappings=(("EmpID", "EmpID"), ("Salary", "Pay")), key_columns=("EmpID",))
    r = reconcile(src, tgt, spec)
    d = r.discrepancies().collect()
    assert [(x.EmpID, x["Column Name"], x["Source Value"], x["Target Value"]) for x in d] == [("2", "Salary - Pay", "2000", "2500")]
    assert r.missing_in_target().count() == 0 and r.missing_in_source().count() == 0
    # reconciling a table with itself: nothing differs, nothing missing
    same = reconcile(src, src, ReconSpec(mappings=(("EmpID", "EmpID"), ("Salary", "Salary")), key_columns=("EmpID",)))
    assert same.discrepancies().count() == 0
    m = summary_map(same)
    assert m["Total Validation Issues"] == 0


def test_edge_dups(spark):
    src = spark.createDataFrame([("K", "1", "10"), ("K", "2", "20"), ("K", "3", "30"), ("L", "1", "5")], "k string, pos string, v string")
    tgt = spark.createDataFrame([("K", "1", "10"), ("K", "2", "21"), ("M", "1", "7")], "k string, pos string, v string")
    spec = ReconSpec(mappings=(("k", "k"), ("pos", "pos"), ("v", "v")), key_columns=("k",), order_by=("pos",))
    r = reconcile(src, tgt, spec)
    m = summary_map(r)
    assert m["Matched Records"] == 2 and m["Surplus Duplicates in Source"] == 1
    assert [x.k for x in r.missing_in_target().collect()] == ["L"]
    assert [x.k for x in r.missing_in_source().collect()] == ["M"]
    d = r.discrepancies().collect()
    assert [(x.k, x["Column Name"], x["Source Value"], x["Target Value"]) for x in d] == [("K", "v - v", "20", "21")]
    statuses = sorted(x["Record Status"] for x in r.full_data().collect())
    assert statuses == ["MATCHED", "MATCHED", "MISSING_IN_SOURCE", "MISSING_IN_TARGET"]


def test_swap_sides_swaps_missing(spark):
    s, t, fx = load(spark, SF_CHECK, "conv")
    a = summary_map(reconcile(s, t, fx.spec))
    b = summary_map(reconcile(t, s, fx.spec))
    assert a["Records Missing in Target"] == b["Records Missing in Source"]
    assert a["Records Missing in Source"] == b["Records Missing in Target"]


def _sorted_cells(r):
    return sorted(tuple(x) for x in r.discrepancies().collect())


def test_hot_key_path_matches_plain_path(spark):
    """Force every duplicated key of `lines` through the range-partitioned
    skew path: paired rows, cells and counts must be identical."""
    s, t, fx = load(spark, SF_CHECK, "lines")
    plain = reconcile(s, t, fx.spec, hot_keys=[])
    dup = (plain.prepared.source.groupBy("_key").count().where("count > 1").select("_key"))
    hot = [x._key for x in dup.collect()]
    assert len(hot) > 10_000     # more than are broadcast: the list is joined
    skew = reconcile(s, t, fx.spec, hot_keys=hot)
    assert summary_map(plain) == summary_map(skew)
    assert _sorted_cells(plain) == _sorted_cells(skew)
    cols = ["_key", "_rn", "_status"]
    a = sorted(tuple(x) for x in plain.paired.select(*cols).collect())
    b = sorted(tuple(x) for x in skew.paired.select(*cols).collect())
    assert a == b


def test_single_hot_key_blank_keys(spark):
    """A third of all rows share one (blank) key: the skew path pairs them by
    position just like the plain path."""
    n = 3000
    src = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.col("id").cast("string")).alias("k"),
                                F.col("id").cast("string").alias("v"))
    tgt = src.withColumn("v", F.when(F.col("v") == "30", F.lit("x")).otherwise(F.col("v")))
    spec = ReconSpec(mappings=(("k", "k"), ("v", "v")), key_columns=("k",), order_by=("v",))
    plain = reconcile(src, tgt, spec, hot_keys=[])
    skew = reconcile(src, tgt, spec, hot_keys=[""])
    assert summary_map(plain) == summary_map(skew)
    assert _sorted_cells(plain) == _sorted_cells(skew)
    # automatic detection (threshold lowered so the blank key counts as hot)
    auto = reconcile(src, tgt, spec, hot_key_rows=500)
    assert summary_map(auto) == summary_map(plain)


def test_write_outputs(spark, tmp_path):
    s, t, fx = load(spark, SF_CHECK, "cust")
    from dataclasses import replace
    r = reconcile(s, t, replace(fx.spec, include_full_data=True))
    out = r.write(str(tmp_path / "out"))
    assert out.cell_discrepancies == CUST_DIFFS and out.status == "Discrepancies found"
    assert spark.read.parquet(out.paths["discrepancies"]).count() == CUST_DIFFS
    assert spark.read.parquet(out.paths["full_data"]).count() == 1500
    with pytest.raises(ValueError, match="unknown output format"):
        r.write(str(tmp_path / "no"), fmt="xlsx")
    conf = spark.read.parquet(out.paths["configuration"]).collect()
    assert sorted((r["Source Column"], r["Is Key?"]) for r in conf) == [("bal", "No"), ("id", "Yes"), ("name", "No"), ("seg", "No")]


def test_pages_and_top_n(spark):
    s, t, fx = load(spark, SF_CHECK, "orders")
    r = reconcile(s, t, fx.spec)
    pages = r.pages(1000).groupBy("page").count().orderBy("page").collect()
    assert [p["count"] for p in pages] == [1000, 1000, 1000, 333]
    top = r.top_n(5).collect()
    assert len(top) == 5 and all(x["Column Name"] == "order_date - ordered_on" for x in top)


def test_number_within_key_hot_equals_window(spark):
    from tally.operators.pair import number_within_key
    df = spark.range(4000).select((F.col("id") % 7 == 0).cast("string").alias("_key"), F.col("id").alias("v"))
    order = [F.col("v").asc()]
    plain = sorted(tuple(r) for r in number_within_key(df, order).collect())
    listed = spark.createDataFrame([("false", 3428)], "_key string, _rows bigint")
    assert plain == sorted(tuple(r) for r in number_within_key(df, order, listed).collect())


def test_pairing_does_not_depend_on_partitions(spark):
    """Duplicates without an order: any partitioning and the hot path give the same cells."""
    s, t, fx = load(spark, SF_SMALL, "dups")
    results = [_sorted_cells(reconcile(s.repartition(n), t.repartition(n + 2), fx.spec)) for n in (1, 4, 7)]
    results.append(_sorted_cells(reconcile(s, t, fx.spec, hot_key_rows=5)))
    assert results[0] and all(r == results[0] for r in results)


def test_equal_duplicates_never_differ(spark):
    """The self-test case with duplicates: same values in any order, one more column on one side."""
    src = spark.createDataFrame([("K", str(i % 3)) for i in range(8)], "EmpID string, Salary string")
    tgt = spark.createDataFrame([("K", str(i % 3), str(i)) for i in reversed(range(8))], "EmpID string, Pay string, more string")
    spec = ReconSpec(mappings=(("EmpID", "EmpID"), ("Salary", "Pay")), key_columns=("EmpID",))
    for n in (1, 4):
        assert reconcile(src.repartition(n), tgt.repartition(n), spec).discrepancies().count() == 0
    first, second = ReconSpec(mappings=spec.mappings, key_columns=("EmpID",), order_by=("seq",)), "EmpID string, Salary string, seq string"
    a = spark.createDataFrame([("K", "x", "1"), ("K", "y", "2")], second)
    b = spark.createDataFrame([("K", "y", "1"), ("K", "x", "2")], second.replace("Salary", "Pay"))
    assert reconcile(a, b, first).discrepancies().count() == 2      # paired by an unmapped column


def test_only_needed_columns_are_read(spark, tmp_path):
    wide = spark.range(20).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("v"), F.lit("b").alias("inc"),
                                  F.lit("big").alias("unmapped1"), F.lit("big").alias("unmapped2"))
    wide.write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    spec = ReconSpec(mappings=(("id", "id"), ("v", "v")), key_columns=("id",), include_columns=("inc",))
    r = reconcile(df, df.where("id <> '3'"), spec)
    for out in (r.summary(), r.discrepancies(), r.column_counts()):
        plan = out._jdf.queryExecution().toString()
        assert "ReadSchema" in plan and "unmapped" not in plan.split("Physical Plan")[1].split("ReadSchema", 1)[1]
        assert plan.split("Physical Plan")[1].count("unmapped") == 0
    lost = r.missing_in_target().collect()
    assert [x.id for x in lost] == ["3"] and lost[0].unmapped1 == "big"


def test_small_sides_are_dealt_out_once(spark):
    """What reads the sides later finds them dealt out, stringified and with keys normalised: no exchange below its own."""
    s, t, fx = load(spark, SF_SMALL, "orders")
    r = reconcile(s, t, fx.spec)
    for side in (r.prepared.source, r.prepared.target):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "o_orderkey" not in plan and "ReadSchema" in plan


def test_filter_below_generator(spark):
    s, t, fx = load(spark, SF_SMALL, "orders")
    plan = reconcile(s, t, fx.spec).discrepancies()._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Generate inline"):]                       # printed from the top
    assert "_any" in below.split("Filter", 1)[1].split("\n", 1)[0]


def test_stored_copy_holds_differences_only(spark):
    s, t, fx = load(spark, SF_SMALL, "orders")
    r = reconcile(s, t, fx.spec)
    m = r.materialize()
    assert summary_map(m) == summary_map(r) and _sorted_cells(m) == _sorted_cells(r)
    assert m.paired.count() < r.paired.count()
    with pytest.raises(ValueError, match="equal rows were not kept"):
        m.full_data()


def test_perfect_match_status(spark):
    df = spark.createDataFrame([("1", "a")], "id string, v string")
    r = reconcile(df, df, ReconSpec(mappings=(("id", "id"), ("v", "v")), key_columns=("id",), source_name="one", target_name="two"))
    texts = {x.metric: x.text for x in r.summary().collect() if x.text}
    assert texts == {"Source File": "one", "Target File": "two", "Status": "All mapped columns matched perfectly"}


def test_profile_of_many_columns(spark):
    import time
    n = 1100
    row = tuple(str(i) if i % 2 else f"t{i}" for i in range(n))
    names = [f"c{i}" for i in range(n)]
    df = spark.createDataFrame([row, row], ", ".join(f"{c} string" for c in names))
    from tally.operators.profile import profile_both
    p = profile_both(df, df, names, ["c0"], set(), set())
    assert p.numeric == {c for i, c in enumerate(names) if i % 2} and p.total_rows == 4
    few = spark.createDataFrame([tuple(f"2024-01-{1 + i % 28:02d}" if i % 3 == 0 else str(i * j) for j in range(61)) for i in range(200)],
                                ", ".join(f"c{i} string" for i in range(61)))
    began = time.time()
    profile_both(few, few, few.columns, ["c0"], set(), set())
    assert time.time() - began < 60      # generous: shared machines


def test_large_numbers_round_to_themselves(spark):
    from tally.functions import clean as C
    df = spark.createDataFrame([("1e305",), ("-1.7e308",), ("123456789012345678",), ("0.00005",)], "v string")
    assert [r[0] for r in df.select(C.diff_numeric(C.clean_number("v"), C.clean_number("v"))).collect()] == [False] * 4


def test_top_n_past_the_merge_limit(spark, monkeypatch):
    from tally.operators import report as R
    s, t, fx = load(spark, SF_SMALL, "orders")
    r = reconcile(s, t, fx.spec)
    small = [tuple(x) for x in r.top_n(50).collect()]
    monkeypatch.setattr(R, "MERGED_ROWS", 10)
    assert [tuple(x) for x in r.top_n(50).collect()] == small
