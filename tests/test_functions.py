"""Scalar rules on the inline edge fixtures (FIXTURES.md §3)."""

from pyspark.sql import functions as F

from tally.functions import clean as C
from tally.functions import dates as DT

EDGE_NUMBERS = [(1, '1,000', '1000', False), (2, '5%', '5', False), (3, '', '', False), (4, '', '0', True),
                (5, 'nan', 'nan', True), (6, 'nan', '', True), (7, '1.00004', '1.0', False), (8, '1.0002', '1.0', True),
                (9, '1.0001', '1.0', False), (10, '1e3', '1000', False), (11, '1d', '1', True), (12, 'abc', 'xyz', False),
                (13, 'inf', 'inf', True), (14, '-5.50', '-5.5', False), (15, '1_000', '1000', True), (16, ' 7 ', '7', False)]

EDGE_STRINGS = [(1, 'a b', 'a  b', False, False), (2, 'Smith, John', 'Smith John', False, False), (3, 'v2.0', 'v2', False, False),
                (4, '1.50', '1.5', True, True), (5, 'None', '', False, False), (6, 'NaT', '', True, True), (7, 'ABC', 'abc', True, False),
                (8, None, '', False, False), (9, 'a\tb', 'ab', False, False), (10, 'a b', 'a b', False, False),
                (11, 'NAN', 'nan', False, False), (12, '1,000.00', '1000', False, False)]

EDGE_KEYS = [(1, 'A b', 'X.0', 'ab|x'), (2, None, '1', '|1'), (3, 'NaN', 'NAN', '|nan'), (4, 'a|b', 'c', 'a|b|c'),
             (5, 'a', 'b|c', 'a|b|c'), (6, '1,000', '2.00', '1,000|2')]

EDGE_DATES = [(1, '05/01/2024', '2024/01/05', '01/25/2024', '2024/01/25', '20240105', '2024/01/05'),
              (2, '31/12/2024', '2024/12/31', '02/26/2024', '2024/02/26', '20241231', '2024/12/31'),
              (3, 'bad', '', '03/04/2024', '2024/03/04', '12345678', '12345678'), (4, '', '', None, '', '', '')]


def test_edge_numbers(spark):
    df = spark.createDataFrame(EDGE_NUMBERS, "id int, s string, t string, differs boolean")
    got = df.select("id", "differs", C.diff_numeric(C.clean_number("s"), C.clean_number("t")).alias("got")).collect()
    assert [(r.id, r.got) for r in got] == [(r.id, r.differs) for r in got]


def test_edge_strings(spark):
    df = spark.createDataFrame(EDGE_STRINGS, "id int, s string, t string, cs boolean, ci boolean")
    got = df.select("id", "cs", "ci",
                    C.diff_string(C.clean_string("s"), C.clean_string("t")).alias("g_cs"),
                    C.diff_string(C.clean_string("s", False), C.clean_string("t", False)).alias("g_ci")).collect()
    assert [(r.id, r.g_cs, r.g_ci) for r in got] == [(r.id, r.cs, r.ci) for r in got]


def test_edge_keys(spark):
    df = spark.createDataFrame(EDGE_KEYS, "id int, k1 string, k2 string, k string")
    got = df.select("id", "k", C.composite_key([C.normalize_key("k1"), C.normalize_key("k2")]).alias("g")).collect()
    assert [(r.id, r.g) for r in got] == [(r.id, r.k) for r in got]


def test_trailing_zero_and_control_rules(spark):
    df = spark.createDataFrame([("v2.0",), ("1.0.0",), ("a\nb",), ("x y",), ("12.000",)], "v string")
    got = [r[0] for r in df.select(C.clean_string("v")).collect()]
    assert got == ["v2", "1.0", "ab", "x y", "12"]
    keys = [r[0] for r in df.select(C.normalize_key(C.normalize_key("v"))).collect()]
    assert keys[1] == "1"          # key rule applied twice, as in the pipeline


def test_edge_dates(spark):
    from tally.operators.profile import detect_dates
    df = spark.createDataFrame(EDGE_DATES, "id int, dmy string, dmy_x string, mdy string, mdy_x string, ymd8 string, ymd8_x string")
    dec = detect_dates(df, ["dmy", "mdy", "ymd8"], set())
    assert all(dec[c].is_date for c in ("dmy", "mdy", "ymd8"))
    assert dec["dmy"].fmt.strftime == "%d/%m/%Y"
    assert dec["mdy"].fmt.strftime == "%m/%d/%Y"
    assert dec["ymd8"].fmt is None
    out = df.select("id", *[DT.normalize_date(c, dec[c].fmt).alias(c) for c in ("dmy", "mdy", "ymd8")],
                    "dmy_x", "mdy_x", "ymd8_x").orderBy("id").collect()
    for r in out:
        assert (r.dmy, r.mdy, r.ymd8) == (r.dmy_x, r.mdy_x, r.ymd8_x)


def test_date_like_and_two_digit_years(spark):
    df = spark.createDataFrame([("2024-01-05",), ("5/1/24",), ("5/1/24x",), ("20240105",), ("2024-01-05T10:00",), ("abc",)], "v string")
    got = [r[0] for r in df.select(DT.date_like(F.col("v"))).collect()]
    assert got == [True, True, False, True, True, False]
    fb = spark.createDataFrame([("05-01-24",), ("05/01/99",), ("5.1.2024",), ("2024-01-05 10:11:12.5",), ("oops",)], "v string")
    got = [r[0] for r in fb.select(DT.normalize_fallback("v")).collect()]
    assert got == ["2024/01/05", "1999/01/05", "2024/01/05", "2024/01/05", "oops"]


def test_float_to_int_text(spark):
    df = spark.createDataFrame([(5.0,), (2.5,), (None,), (-3.0,)], "x double")
    assert [r[0] for r in df.select(C.float_to_int_text("x")).collect()] == ["5", "2.5", None, "-3"]


ODD = ["", None, " ", "a", " a", "a ", "a  b", "a b", "a,b", ",", "1,234.50", "1.0", "1.50", "10", "0.0", "a.00", "nan", "NaN", "None", "NONE", "NaT", "nan ",
       "n,an", "\x7f", "a\tb", "a\n", "\n", "x​y", "x y", "　", "É", "-0", "-0.00", "+1", "1.23456", "1.00005", "999999999.9999", "1234567890.5",
       "12.", ".5", "1e5", "inf", "-Infinity", "5%", "1.0.0", "1,000", "a-b", "~!", "2024-01-05"]


def test_plain_values_are_cleaned_as_by_the_rules(spark):
    """The short ways of plain values against the rules themselves."""
    df = spark.createDataFrame([(t,) for t in ODD], "v string")
    x = C._squashed(C.blank_nulls("v"))
    pairs = [(C.squash_spaces("v"), x), (C.clean_string("v"), C.string_tail(x)), (C.clean_string("v", False), C.string_tail(x, False)),
             (C.clean_number("v"), C.number_tail(x)), (C.normalize_key("v"), C._normalized_key(C.blank_nulls("v"))),
             (C.key_part("v"), F.lower(F.translate(C.blank_nulls("v"), C.white_space_chars(), "")))]
    for row in df.select("v", *[F.struct(a.cast("string").alias("a"), b.cast("string").alias("b")) for a, b in pairs]).collect():
        assert [(p.a, p.b) for p in row[1:] if p.a != p.b] == [], row.v


def test_dates_taken_apart_are_those_parsed(spark):
    texts = ["2024-01-05", "2024-02-30", "2024-02-29", "2023-02-29", "2024-13-01", "0000-01-01", "0999-01-01", "2024-1-5", "05/06/2024", "31/06/2024", "28-02-2024",
             "2024-01-05 23:59:59", "2024-01-05 24:00:00", "2024-01-05T01:02:03", "2024-01-05\n", "05-06-2024 10:00:60", "x", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for f in DT.FORMATS:
        plain = F.coalesce(F.date_format(DT.parse_with(C.blank_nulls("v"), f), DT.OUTPUT_PATTERN), F.lit(""))
        assert df.where(~DT.normalize_known("v", f).eqNullSafe(plain)).count() == 0


def test_rules_leave_code_that_the_jvm_compiles(spark):
    """No method of a digest pass or of the profile's counts is over 8,000 bytes, beyond which HotSpot does not compile it."""
    from tally.operators import profile as PR
    from tally.operators.judge import digests
    names = [f"c{i}" for i in range(8)]
    df = spark.range(5).select(F.col("id").cast("string").alias("_key"), *[F.col("id").cast("string").alias(c) for c in names])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        for frame in (digests(df, 1, names, [], set(names[4:]), True).groupBy("_key").agg(F.bit_xor("_c1")),
                      PR.shape_histogram(PR._raw_cells(df, names, {"c0"}, "s"))):
            stats = debug.codegenStringSeq(frame._jdf.queryExecution().executedPlan())
            sizes = [stats.apply(i)._3().maxMethodCodeSize() for i in range(stats.size())]
            assert sizes and max(sizes) <= 8000, sizes
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
