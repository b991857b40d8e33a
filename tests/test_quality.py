import pytest
from pyspark.sql import functions as F

from feedwright.operators import quality
from feedwright.sources.delimited import parse_delimited_lines, read_delimited

OK, LENGTH, OVERFLOW, MISMATCH = None, "MAX_LENGTH_EXCEEDED", "NUMERIC_OVERFLOW", "DATA_TYPE_MISMATCH"


def issues(spark, ddl, cells, **options):
    frame = spark.createDataFrame([(k, cell) for k, cell in enumerate(cells)], "k int, c string")
    annotated = quality.annotate(frame.select("c", "k"), ddl, keep=["k"], **options)
    return [row["_any_issue"] for row in annotated.orderBy("k").collect()]


@pytest.mark.parametrize(
    "ddl, cells, expected",
    [
        ("c char(3)", ["abc", "abcd", "", None], [OK, LENGTH, OK, OK]),
        ("c varchar(1)", ["", "x", "xy"], [OK, OK, LENGTH]),
        ("c string", ["anything at all"], [OK]),
        ("c int", ["0", "-5", " 7", "-", "", None], [OK] * 6),
        ("c int", ["007", "1.0", "abc", "7 x", "--1"], [MISMATCH] * 5),
        ("c int", ["-007", "2147483647", "2147483648", "-2147483647"], [OK, OK, OVERFLOW, OK]),
        ("c smallint", ["32767", "32768", "-32768"], [OK, OVERFLOW, OVERFLOW]),
        ("c tinyint", ["127", "128", "-"], [OK, OVERFLOW, OK]),
        ("c bigint", ["9223372036854775807", "9223372036854775808", "-9223372036854775808"], [OK, MISMATCH, MISMATCH]),
        ("c int", ["99999999999999999999"], [MISMATCH]),
        (
            "c decimal(8,2)",
            ["123456.78", "1234567.8", "1.234", ".5", "1e5", "-123456.78", "", "000000001", "1.2.3"],
            [OK, OK, OVERFLOW, OK, MISMATCH, OK, OK, OVERFLOW, MISMATCH],
        ),
        ("c date", ["2020-01-31", "31/01/2020", "2020-99-99", "20200131", "2020-01-31 10:20:30"], [OK, OK, OK, MISMATCH, MISMATCH]),
        (
            "c timestamp",
            ["2020-01-31", "2020-01-31 10:20:30", "1/2/2020 1:02:03 PM", "1/2/2020 1:02:03pm", "10:20"],
            [OK, OK, OK, OK, MISMATCH],
        ),
    ],
)
def test_edge_cells(spark, ddl, cells, expected):
    assert issues(spark, ddl, cells) == expected


def test_bounds_as_coded(spark):
    assert issues(spark, "c smallint", ["327687", "327688"], bounds="as_coded") == [OK, OVERFLOW]
    assert issues(spark, "c tinyint", ["1"], bounds="as_coded") == [OVERFLOW]


def test_strict_decimal(spark):
    assert issues(spark, "c decimal(8,2)", ["1234567.8", "123456.78"], strict_decimal=True) == [OVERFLOW, OK]


def test_unknown_type_raises(spark):
    with pytest.raises(ValueError, match="no validation rule"):
        quality.declared_columns("c array<int>")


def test_split_keeps_every_row_once(spark, rows):
    frame = spark.createDataFrame([("1", "a"), ("x", "b"), ("2", "toolong"), (None, None)], "n string, t string")
    result = quality.datacop(frame, "n int, t varchar(3)", 1, "d", "s", "t")
    assert sorted(rows(result.good) + rows(result.bad.drop("issues")), key=repr) == rows(frame)
    assert rows(result.totals) == [(1, "d", "s", "t", 2, 2)]
    assert rows(result.summary, "column_name", "column_type", "column_type_extra", "issue_type", "issue_count") == [
        ("n", "int", "Size: [3]", MISMATCH, 1),
        ("t", "varchar", "Length: [3]", LENGTH, 1),
    ]


def test_row_report_numbers(spark, rows):
    frame = spark.createDataFrame([(2, "1"), (3, "x"), (4, "2"), (5, "y")], "line int, n string").select("n", "line")
    annotated = quality.annotate(frame, "n int", keep=["line"])
    report = quality.datacop_row_report(annotated, "line", with_bad_record_no=True)
    assert rows(report, "row_no", "bad_record_no", "column_position", "data_item") == [(3, 2, 0, "x"), (5, 3, 0, "y")]


def test_column_count(spark, rows, tmp_path):
    path = tmp_path / "ragged.csv"
    path.write_text("a,b,c\n1,2,3\n1,2\n1,2,3,4\n5,,\n")
    frame = read_delimited(spark, str(path), columns=["a", "b", "c"], corrupt=True)
    result = quality.datacop(frame, "a int, b int, c int")
    assert rows(result.good) == [("1", "2", "3"), ("5", None, None)]
    assert rows(result.summary, "column_name", "issue_type", "issue_count") == [(None, "COLUMN_COUNT", 2)]
    mangled = quality.datacop(frame, "a int, b int, c int", mangle_column_count=True)
    assert mangled.good.count() == 4 and mangled.bad.count() == 0


def test_max_issues(spark):
    frame = spark.createDataFrame([("x",)] * 6, "n string")
    assert quality.enforce_max_issues(quality.datacop(frame, "n int").summary, 6) == 6
    with pytest.raises(ValueError, match="detected 6 issues"):
        quality.datacop(frame, "n int", max_issues=5)
    # wrong widths are not counted as issues
    ragged = parse_delimited_lines(spark.createDataFrame([("1,2",)] * 9, "value string"), ["n"], corrupt=True)
    quality.datacop(ragged, "n int", max_issues=0)


def test_extra_columns_and_substitution(spark, rows):
    frame = spark.createDataFrame([("1$", "x", "more")], "n string, t string, u string")
    result = quality.datacop(frame, "n int, t varchar(1)", global_sub=(r"\$", ""))
    assert rows(result.good) == [("1", "x")]


def test_good_filter_reads_only_codes(spark):
    """The good branch never builds the issue array."""
    frame = spark.range(3).select(F.col("id").cast("string").alias("n"))
    plan = quality.datacop(frame, "n int").good._jdf.queryExecution().optimizedPlan().toString()
    assert "struct" not in plan
