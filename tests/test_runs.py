"""Judged keys, runs of equal rows, shape histogram, CSV splits and page files against plain versions."""

import csv
import io
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tally import ReconSpec, reconcile
from tally.operators import pair as P
from tally.operators import profile as PR
from tally.operators import runs as RU
from tally.operators.judge import judge
from tally.plans.fixtures import load
from tally.plans.queries import files_in_order
from tally.sources.files import csv_reader, scan_csv_strings

from paths import SF_SMALL

# ---- judged keys


def keyed(spark, rows):
    return spark.createDataFrame(rows, "_key string, a string, b string").repartition(3)


def judged(spark, s, t, numeric=("b",), order_by=(), hot=10):
    j = judge(keyed(spark, s), keyed(spark, t), ["a", "b"], list(order_by), set(numeric), True, hot)
    return j, {(r["_key"], r["_ns"], r["_nt"]) for r in j.keys.where("_open").collect()}


def test_keys_that_agree_leave(spark):
    s = [("same", "x", "1"), ("cleaned", " x ", "1.00"), ("number", "x", "1"), ("nan", "x", "nan"), ("inf", "x", "-inf"), ("gone", "x", "1"),
         ("null", None, None), ("shift", "x", None), ("twice", "x", "1"), ("twice", "y", "2"), ("raw", " x", "1"), ("raw", "y", "1"),
         ("more", "x", "1"), ("more", "x", "1"), ("pairs", "a", "1"), ("pairs", "a", "1"), ("garbage", "x", "abc")]
    t = [("same", "x", "1"), ("cleaned", "x", "1"), ("number", "x", "2"), ("nan", "x", "nan"), ("inf", "x", "-inf"), ("new", "x", "1"),
         ("null", "", ""), ("shift", None, "x"), ("twice", "y", "2"), ("twice", "x", "1"), ("raw", "x", "1"), ("raw", "y", "1"),
         ("more", "x", "1"), ("pairs", "b", "1"), ("pairs", "b", "1"), ("garbage", "x", "xyz")]
    j, got = judged(spark, s, t)
    assert got == {("number", 1, 1), ("nan", 1, 1), ("inf", 1, 1), ("gone", 1, 0), ("new", 0, 1), ("shift", 1, 1), ("raw", 2, 2), ("more", 2, 1),
                   ("pairs", 2, 2)}
    c = j.counts
    assert (c["source_rows"], c["target_rows"], c["matched"]) == (17, 16, 15)
    assert (c["missing_in_target"], c["missing_in_source"], c["surplus_in_source"], c["surplus_in_target"]) == (1, 1, 1, 0)
    assert (c["duplicate_key_rows_in_source"], c["duplicate_key_rows_in_target"]) == (8, 6)
    assert j.has_duplicates and {r["_key"] for r in j.one_sided("source").collect()} == {"gone"}


def test_nulls_in_different_columns_do_not_agree(spark):
    """A hash alone skips nulls; with many rows a key, null and blank are told apart, as they sort apart."""
    s = [("k", None, "x"), ("k", "", "y")]
    t = [("k", "", "x"), ("k", None, "y")]
    assert judged(spark, s, t, numeric=())[1] == {("k", 2, 2)}
    s = [("k", "x", None)]
    t = [("k", None, "x")]
    assert judged(spark, s, t, numeric=("a", "b"))[1] == set()      # neither casts: equal as numbers
    assert judged(spark, [("k", "1", None)], [("k", None, "1")], numeric=("a", "b"))[1] == {("k", 1, 1)}


def test_hot_keys_are_kept_though_they_agree(spark):
    rows = [("hot", str(i), "1") for i in range(8)] + [("k", "a", "1")]
    j, got = judged(spark, rows, rows, hot=10)
    assert got == set() and [r["_key"] for r in j.hot().collect()] == ["hot"]
    assert judged(spark, rows, rows, hot=16)[0].hot() is None


# ---- pairs

def plain_pairs(source, target):
    """(key, position, status, source value, target value, rows on each side), by sorting each key's rows."""
    sides = []
    for rows in (source, target):
        by = defaultdict(list)
        for k, v in rows:
            by[k].append(v)
        sides.append({k: sorted(v, key=lambda x: (x is not None, x or "")) for k, v in by.items()})
    s, t = sides
    out = []
    for k in set(s) | set(t):
        a, b = s.get(k, []), t.get(k, [])
        for i in range(max(len(a), len(b))):
            status = ("MATCHED" if i < min(len(a), len(b)) else "MISSING_IN_TARGET" if not b else "MISSING_IN_SOURCE" if not a
                      else "SURPLUS_IN_SOURCE" if i < len(a) else "SURPLUS_IN_TARGET")
            out.append((k, i, status, a[i] if i < len(a) else None, b[i] if i < len(b) else None, len(a), len(b)))
    return sorted(out, key=str)


def told(pairs):
    return sorted(((r["_key"], r["_rn"], r["_status"], r["_s_v"], r["_t_v"], r["_ns"], r["_nt"]) for r in RU.expanded(pairs).collect()), key=str)


@pytest.mark.parametrize("bucket", [1, 3, 65_536])
def test_runs_pair_as_single_rows_do(spark, monkeypatch, bucket):
    monkeypatch.setattr(RU, "BUCKET", bucket)
    rng = random.Random(bucket)
    keys = ["", "a", "b", "c", "d", "e"]
    side = lambda n, ks: [(rng.choice(ks), rng.choice([None, "", "x", "y", "z"])) for _ in range(n)]
    source, target = side(120, keys[:5]), side(90, keys[1:])
    frame = lambda rows: spark.createDataFrame(rows, "_key string, v string").repartition(3)
    expected = plain_pairs(source, target)
    for hot in (None, ["", "a"], keys):
        listed = None if hot is None else spark.createDataFrame([(k, 1) for k in hot], "_key string, _rows bigint")
        assert told(P.pair_rows(frame(source), frame(target), ["v"], ["v"], [], listed)) == expected
    once = lambda rows: list({k: (k, v) for k, v in rows}.values())
    s, t = once(source), once(target)
    assert told(P.pair_rows(frame(s), frame(t), ["v"], ["v"], [], None, unique=True)) == plain_pairs(s, t)
    assert told(P.pair_rows(frame([]), frame(t), ["v"], ["v"], [], None)) == plain_pairs([], t)


def test_small_keys_pair_as_lists(spark):
    """Keys with few rows: no window, no sort but by key, and the same pairs as the sweep finds, nulls, equal rows and other orders included."""
    rng = random.Random(5)
    side = lambda n, ks: [(rng.choice(ks), rng.choice([None, "", "x", "y"]), rng.choice([None, "1", "2"]), rng.choice(["7", "8", None])) for _ in range(n)]
    frame = lambda rows: spark.createDataFrame(rows, "_key string, v string, w string, o string").repartition(3)
    s, t = frame(side(150, ["", "a", "b", "c", "d"])), frame(side(120, ["a", "b", "c", "d", "e"]))
    rows = lambda pairs: sorted((tuple(r[c] for c in sorted(pairs.columns) if c != "_copies") for r in RU.expanded(pairs).collect()), key=str)
    for order in ([], ["w"], ["o"], ["o", "w"]):
        pairs = [P.pair_rows(s, t, ["v", "w"], ["v"], order, None, small=small) for small in (True, False)]
        assert rows(pairs[0]) == rows(pairs[1])
        assert "Window" not in pairs[0]._jdf.queryExecution().executedPlan().toString()
    r = reconcile(s.withColumnRenamed("_key", "k"), t.withColumnRenamed("_key", "k"), ReconSpec(mappings=[(c, c) for c in "kvw"], key_columns=["k"]))
    assert "Window" not in r.paired._jdf.queryExecution().executedPlan().toString()


def test_rows_to_pair_carry_each_value_once(spark, monkeypatch):
    """Both sides share their value columns, an ordering column among them is not added, and only an end that the other side
    goes on from is an event of its own; context columns (source only) and an order that is not compared stay right."""
    widths, pair = [], P.cold_pairs
    monkeypatch.setattr(P, "cold_pairs", lambda u, *rest: widths.append(len(u.columns)) or pair(u, *rest))
    s = spark.createDataFrame([("k", "a", "2", "c2", "9"), ("k", "b", "1", "c1", "8"), ("k", "b", "1", "c1", "8"), ("m", "x", None, None, "1")],
                              "_key string, v string, w string, ctx string, o string")
    t = spark.createDataFrame([("k", "q", "1", "9"), ("k", "b", "1", "8"), ("n", "y", "3", "1")], "_key string, v string, w string, o string")
    rows = lambda order: sorted(((r["_key"], r["_rn"], r["_status"], r["_s_v"], r["_s_w"], r["_s_ctx"], r["_t_v"], r["_t_w"])
                                 for r in RU.expanded(P.pair_rows(s, t, ["v", "w", "ctx"], ["v", "w"], order)).collect()), key=str)
    others = [("m", 0, "MISSING_IN_TARGET", "x", None, None, None, None), ("n", 0, "MISSING_IN_SOURCE", None, None, None, "y", "3")]
    by_o = [("k", 0, "MATCHED", "b", "1", "c1", "b", "1"), ("k", 1, "MATCHED", "b", "1", "c1", "q", "1"),
            ("k", 2, "SURPLUS_IN_SOURCE", "a", "2", "c2", None, None)]
    assert rows(["w"]) == by_o + others        # w, then v: the same pairs
    assert rows(["o"]) == by_o + others
    by_v = [("k", 0, "MATCHED", "a", "2", "c2", "b", "1"), ("k", 1, "MATCHED", "b", "1", "c1", "q", "1"),
            ("k", 2, "SURPLUS_IN_SOURCE", "b", "1", "c1", None, None)]
    assert rows([]) == by_v + others
    assert widths == [5, 6, 5]                 # key, side, three values (and ``o``)


def test_many_equal_rows_of_one_key_are_few_runs_and_spread(spark):
    """Ten million equal rows of one key: few runs, cut by position, and no task gets them all."""
    n = 5_000_000
    s = spark.range(n).select(F.lit("").alias("_key"), F.lit("x").alias("v"))
    t = spark.range(n + 10).select(F.lit("").alias("_key"), F.when(F.col("id") < 7, "y").otherwise("x").alias("v"))
    hot = spark.createDataFrame([("", 2 * n)], "_key string, _rows bigint")
    rows = P.pair_rows(s, t, ["v"], ["v"], [], hot).withColumn("task", F.spark_partition_id()).collect()
    assert sum(r["_copies"] for r in rows) == n + 10 and len(rows) < 100
    copies, tasks = Counter(), Counter()
    for r in rows:
        copies[r["_status"], r["_s_v"], r["_t_v"]] += r["_copies"]
        tasks[r["task"]] += r["_copies"]
    assert copies == {("MATCHED", "x", "x"): n, ("SURPLUS_IN_TARGET", None, "x"): 3, ("SURPLUS_IN_TARGET", None, "y"): 7}
    assert max(tasks.values()) < n / 2


def test_judged_result_is_that_of_all_pairs(spark):
    """What is left out of the pairing changes no output."""
    for name in ("dups", "runs", "texts"):
        s, t, fx = load(spark, SF_SMALL, name)
        r = reconcile(s, t, fx.spec, hot_key_rows=500)
        every = reconcile(s, t, fx.spec, hot_key_rows=500)
        every.FILTER_SHARE = 0.0                    # never leave anything out
        cells = lambda x: sorted(map(str, x.discrepancies().collect()))
        assert cells(r) == cells(every) and cells(r)
        assert sorted(map(str, r.summary().collect())) == sorted(map(str, every.summary().collect()))
        lost = r.paired.where("_status = 'MISSING_IN_TARGET'").select("_key").distinct().count()
        assert lost == r.judged.one_sided("source").count()


# ---- shape histogram

TEXTS = ["", " ", "nan", "None", "NaN", "NaT", "none", "NAN", "1", "-1", "+1.5", "1,000.25", "50%", "1e5", "1E-3", "1e5.0", "1.0.0", "-5.0", "nan.0",
         "inf", "-Infinity", "infinit", "2024-01-05", "2024/1/5 10:00:00", "2024-01-05T01:02:03", "5-6-2024", "05/06/24", "05/06/24x", "05/06/24 x",
         "20240105", "202401051", " 2024-01-05 ", " 2024-01-05", "12 Main Street", "12-13-14 Main", "apple", "a-b", "Inf-x", "n-1", "É-1",
         "​5.0", "5.0 ", "9" * 70, "9" * 70 + ".0", " " * 70, "1-2-" * 20, "2024-01-05" + "x" * 70, "\t7", "7\n", "٣", "1d", "0x1p3",
         ".5", "5.", ".", "-", "e5", "　", "NaN ", "  nan", "nan ", "1%2", "%", ",", "i", "n", "yes", "True", "t", "f", "y", "O"]


def test_shapes_count_as_every_cell_does(spark):
    rng = random.Random(2)
    rows = [(t, t, rng.choice(TEXTS)) for t in TEXTS for _ in range(3)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "k string, v string, w string")
    cells = PR._raw_cells(df, ["k", "v", "w"], {"k"}, "s")
    n = lambda c: F.count_if(F.col(c)).cast("bigint")
    names = ("nonsentinel", "date_like", "numbers_of", "castable", "with_dash")
    plain = (PR._verdicts(PR._judged_cells(cells)).groupBy("side", "column_name")
             .agg(F.count(F.lit(1)).alias("rows"), *[n(v).alias(c) for v, c in zip(PR.VERDICTS, names)]))
    assert sorted(map(str, PR.text_counts(cells).select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    one = spark.createDataFrame([(t,) for t in TEXTS], "v string")     # and text by text, as a key and as a value
    for keys in (set(), {"v"}):
        cells = PR._raw_cells(one, ["v"], keys, "s").withColumn("column_name", F.col("raw"))
        plain = PR._verdicts(PR._judged_cells(cells)).select("column_name", *[F.col(v).cast("long").alias(c) for v, c in zip(PR.VERDICTS, names)])
        assert sorted(map(str, PR.text_counts(cells).select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_columns_have_few_shapes(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("i"), F.concat(F.lit("name "), F.col("id")).alias("t"),
                                    F.format_string("%.2f", F.col("id") / 7).alias("p"), F.concat(F.col("id"), F.lit(" Main Street")).alias("s"))
    assert PR.shape_histogram(PR._raw_cells(df, df.columns, set(), "s")).count() < 20


# ---- CSV in splits

def split_scan(spark, path, size, **options):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        df = scan_csv_strings(spark, path, **options)
        return df.columns, [tuple(r) for r in (df.orderBy("_row_order") if "_row_order" in df.columns else df).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def random_csv(seed, rows, end="\n"):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(["a", "b", ",", '"', "\n", " ", "é", "\r\n", '""']) for _ in range(rng.choice([0, 1, 3, 8, 40])))
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(["id", "x", "y"])
    data = [(str(i), cell(), cell()) for i in range(rows)]
    w.writerows(data)
    return out.getvalue(), [tuple(v or None for v in r) for r in data]


@pytest.mark.parametrize("end,size", [("\n", 40), ("\n", 300), ("\r\n", 64), ("\n", 1 << 27)])
def test_csv_with_quoted_line_ends_in_splits(spark, tmp_path, end, size):
    text, expected = random_csv(size, 150, end)
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    names, got = split_scan(spark, str(path), size, row_order=True)
    assert names == ["id", "x", "y", "_row_order"] and [r[:3] for r in got] == expected


def test_csv_records_longer_than_splits_and_several_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    long = "line\n" * 200
    for k in range(3):
        (folder / f"part-{k}.csv").write_text(f'id,x\n{k}a,"{long}"\n\n{k}b,plain\n{k}c,"""{long}"\n{k}d,5" disk\n{k}e\n{k}f,1,2,3\n')
    names, got = split_scan(spark, str(folder), 50, row_order=True)
    expected = [r for k in range(3) for r in ((f"{k}a", long), (f"{k}b", "plain"), (f"{k}c", '"' + long), (f"{k}d", '5" disk'), (f"{k}e", None),
                                              (f"{k}f", "1"))]
    assert [r[:2] for r in got] == expected
    whole = [tuple(r) for r in csv_reader(spark).csv(str(folder)).collect()]      # the reader that it replaces
    assert sorted(r[:2] for r in got) == sorted(whole)


def test_csv_without_end_and_without_rows(spark, tmp_path):
    (tmp_path / "open.csv").write_text('id,x\n1,a\n2,"never\nclosed')
    assert sorted(split_scan(spark, str(tmp_path / "open.csv"), 5)[1]) == [("1", "a"), ("2", "never\nclosed")]
    (tmp_path / "head.csv").write_text("id,x\n")
    assert split_scan(spark, str(tmp_path / "head.csv"), 5) == (["id", "x"], [])


def test_duplicates_pair_as_written(spark):
    """The same files in any number of splits: rows of a key meet in file order, not in that of their values."""
    results = []
    for size in (1 << 27, 2_000, 9_000):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        try:
            results.append(sorted(map(str, files_in_order(spark, SF_SMALL).discrepancies().collect())))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    s, t, fx = load(spark, SF_SMALL, "files")
    assert results[0] and results[0] == results[1] == results[2] == sorted(map(str, reconcile(s, t, fx.spec).discrepancies().collect()))


# ---- page files

def test_page_files_are_exact(spark, tmp_path):
    s, t, fx = load(spark, SF_SMALL, "orders")
    r = reconcile(s, t, fx.spec)
    total = r.discrepancies().count()
    for fmt in ("parquet", "csv"):
        out = r.write_pages(str(tmp_path / fmt), 50, fmt)
        files = sorted((tmp_path / fmt).glob("part-*"))
        read = (lambda f: spark.read.parquet(str(f))) if fmt == "parquet" else (lambda f: scan_csv_strings(spark, str(f)))
        pages = [[tuple(x) for x in read(f).collect()] for f in files]
        assert out and [len(p) for p in pages] == [50] * (total // 50) + [total % 50] * (total % 50 > 0)
        expected = [tuple(x) for x in r.report().collect()]
        blank = lambda rows: [tuple(v or None for v in x) for x in rows]
        assert blank(x for p in pages for x in p) == blank(expected)


def test_many_pages_are_written_by_few_tasks(spark, tmp_path):
    s, t, fx = load(spark, SF_SMALL, "orders")
    r = reconcile(s, t, fx.spec).materialize()
    files = sorted((tmp_path / "many").glob("part-*") if r.write_pages(str(tmp_path / "many"), 3) else [])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    expected = [tuple(x) for x in r.report().collect()]
    assert len(files) == -(-len(expected) // 3) > tasks >= len({f.name[:10] for f in files})
    pages = [[tuple(x) for x in spark.read.parquet(str(f)).collect()] for f in (files[0], files[1], files[len(files) // 2], files[-1])]
    at = [0, 3, 3 * (len(files) // 2), 3 * (len(files) - 1)]
    assert pages == [expected[i:i + 3] for i in at]


def test_page_files_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([("1", "a")], "id string, v string")
    r = reconcile(df, df, ReconSpec(mappings=(("id", "id"), ("v", "v")), key_columns=("id",)))
    assert spark.read.parquet(r.write_pages(str(tmp_path / "none"), 10)).count() == 0


# ---- top n, and all outputs or none

def test_first_rows_without_a_sort(spark):
    """For any n the condition holds for the first n rows and few others; ties in all columns stay together."""
    from tally.operators import report as R
    rng = random.Random(9)
    rows = [(rng.choice(["a - b", "a - c", "x"]), rng.choice(["", "1", "12", "123", "1234", "12345", "é", "zz"]) + rng.choice(["", "0", "7"])) for _ in range(400)]
    df = spark.createDataFrame(rows, "l string, k string").repartition(5)
    rows.sort(key=lambda r: (r[0].encode(), r[1].encode()))
    for n, most in ((1, 0), (37, 0), (200, 5), (399, 0), (400, 0), (900, 0)):
        got = sorted((tuple(r) for r in df.where(R.first_rows(df, ["l", "k"], n, most)).collect()), key=lambda r: (r[0].encode(), r[1].encode()))
        assert got == rows[:len(got)] and len(got) >= min(n, 400)
        assert len(got) <= n + most or all(r == rows[n - 1] for r in got[n - 1:])


def test_top_n_past_the_merge_limit_reads_few_rows(spark, monkeypatch):
    from tally.operators import report as R
    s, t, fx = load(spark, SF_SMALL, "conv")
    r = reconcile(s, t, fx.spec)
    expected = [tuple(x) for x in r.report().limit(30).collect()]
    monkeypatch.setattr(R, "MERGED_ROWS", 4)
    seen = []
    plain = R.global_positions
    monkeypatch.setattr(R, "global_positions", lambda df, *a, **k: (seen.append(df.count()), plain(df, *a, **k))[1])
    assert [tuple(x) for x in r.top_n(30).collect()] == expected and seen and seen[0] <= 34


def test_a_failed_run_leaves_the_former_outputs(spark, tmp_path, monkeypatch):
    from tally.plans import pipeline as PL
    s, t, fx = load(spark, SF_SMALL, "orders")
    r = reconcile(s, t, fx.spec)
    out = str(tmp_path / "out")
    first = r.write(out)
    assert PL.latest_outputs(spark, out) == first.paths
    before = sorted(map(str, spark.read.parquet(first.paths["summary"]).collect()))
    calls = []

    def failing(df, path, *a):
        calls.append(path)
        if len(calls) == 3:
            raise RuntimeError("no space")
        return plain(df, path, *a)

    plain = PL.write_table
    monkeypatch.setattr(PL, "write_table", failing)
    with pytest.raises(RuntimeError, match="no space"):
        r.write(out)
    assert len(calls) == 3 and PL.latest_outputs(spark, out) == first.paths
    assert sorted(map(str, spark.read.parquet(PL.latest_outputs(spark, out)["summary"]).collect())) == before
    monkeypatch.setattr(PL, "write_table", plain)
    second = r.write(out, fmt="csv")
    assert PL.latest_outputs(spark, out) == second.paths != first.paths
    assert [x["format"] for x in PL.runs_in(spark, out).orderBy("began").collect()] == ["parquet", "csv"]
    assert spark.read.parquet(first.paths["discrepancies"]).count() == scan_csv_strings(spark, second.paths["discrepancies"]).count()


def test_values_that_are_no_numbers_are_counted(spark):
    s = spark.createDataFrame([(str(i), str(i) if i % 10 else "abc") for i in range(40)], "k string, v string")
    t = spark.createDataFrame([(str(i), str(i) if i % 10 else "xyz") for i in range(40)], "k string, v string")
    r = reconcile(s, t, ReconSpec(mappings=(("k", "k"), ("v", "v")), key_columns=("k",)))
    assert r.discrepancies().count() == 0
    assert {x["column_name"]: x["uncastable"] for x in r.uncastable().collect()} == {"k": 0, "v": 8}
