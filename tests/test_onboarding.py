import json

import pytest
from pyspark.sql import functions as F

from feedwright.functions import columns, dates, text, types
from feedwright.operators import onboarding


def inferred(spark, cells, dialect="spark"):
    frame = spark.createDataFrame([(cell,) for cell in cells], "c string")
    return onboarding.infer_types(frame, dialect).first()["type"]


@pytest.mark.parametrize(
    "cells, expected",
    [
        (["1", "-5", "0"], "TINYINT"),
        (["126"], "TINYINT"),
        (["127"], "SMALLINT"),
        (["32767"], "INT"),
        (["2147483647"], "BIGINT"),
        (["9223372036854775807"], "VARCHAR(100)"),
        (["007"], "VARCHAR(3)"),
        (["1", "2.50"], "DECIMAL(3,2)"),
        (["1000", "2.5", "-0.125"], "DECIMAL(7,3)"),
        (["2020-01-01", "2020-01-01 10:00:00"], "TIMESTAMP"),
        (["2020-01-01 10:00:00", "2020-01-01"], "TIMESTAMP"),
        (["2020/1/1"], "DATE"),
        (["1", "2020-01-01"], "VARCHAR(100)"),
        (["2020-01-01", "1"], "VARCHAR(100)"),
        (["1/2/2020 1:02:03 PM"], "VARCHAR(100)"),
        (["abcd"], "VARCHAR(4)"),
        (["abcde"], "VARCHAR(100)"),
        (["x" * 101], "VARCHAR(101)"),
        ([None], "VARCHAR(100)"),
        (["1", None], "TINYINT"),
        (["1" * 30 + "." + "2" * 10], "STRING"),
    ],
)
def test_inference(spark, cells, expected):
    assert inferred(spark, cells) == expected
    assert inferred(spark, cells[::-1]) == expected


def test_dialects_and_ddl(spark):
    frame = spark.createDataFrame([("1", "2020-01-01 10:00:00", "1.5", "x")], "a string, b string, c string, d string")
    assert onboarding.ddl_from_inference(onboarding.infer_types(frame, "postgres")) == (
        "(a SMALLINT, b TIMESTAMP, c NUMERIC(2,1), d VARCHAR(1))"
    )
    warehouse = onboarding.ddl_from_inference(onboarding.infer_types(frame, "bigquery"), "bigquery")
    assert [field["type"] for field in json.loads(warehouse)] == ["INTEGER", "STRING", "FLOAT", "STRING"]
    with pytest.raises(ValueError):
        onboarding.infer_types(frame, "no such dialect")
    empty = onboarding.infer_types(frame.where("false"))
    assert [row["type"] for row in empty.orderBy("id").collect()] == ["VARCHAR(100)"] * 4


def test_mangler_is_set_for_am_pm(spark):
    frame = spark.createDataFrame([("1/2/2020 1:02:03 PM",)], "c string")
    assert onboarding.infer_types(frame).first()["mangler"] == "ampm_to_timestamp"


@pytest.mark.parametrize(
    "cell, expected",
    [
        ("2020-01-31", "YMD"),
        ("2020-31-01", "YDM"),
        ("31/2020/01", "DYM"),
        ("01/2020/31", "MYD"),
        ("31/01/2020", "DMY"),
        ("01/31/2020", "MDY"),
        ("01/02/2020", None),
        ("01/02/03", None),
    ],
)
def test_date_style(spark, cell, expected):
    frame = spark.createDataFrame([(cell,)], "c string")
    assert onboarding.detect_date_style(frame).first()["date_style"] == expected


def test_names(spark):
    manglers = [(r"[^\w\s]", ""), ("^x", "y")]
    assert onboarding.mangle_column_names(["a b", None, "", "x%c"], manglers) == [
        "a_b",
        "NAMELESS_COLUMN_1",
        "NAMELESS_COLUMN_2",
        "yc",
    ]
    assert onboarding.mangle_column_names(2) == ["COLUMN_1", "COLUMN_2"]
    paths = spark.createDataFrame([("/in/2020-sales.csv",), ("/in/a-b.txt",)], "p string")
    names = [row[0] for row in paths.select(onboarding.table_name_from_path(F.col("p"))).collect()]
    assert names == ["D_2020_sales", "a_b"]


def test_profile_cutoff_and_limit(spark, rows):
    frame = spark.range(1000).selectExpr(
        "case when id % 2 = 0 then 'even' when id % 3 = 0 then null else 'odd' end as a", "id % 80 as b", "id as c"
    )
    profile = onboarding.profile_table(frame, cutoff_percent=2, values_limit=2)
    assert [tuple(map(str, row)) for row in profile.orderBy("count_of_field").collect()] == [
        ("odd", "333", "33.300", "a"),
        ("even", "500", "50.000", "a"),
    ]
    assert onboarding.profile_table(frame, cutoff_percent=1.2, values_limit=2).where("profiled_field = 'b'").count() == 2


def test_top_values_of_a_hot_group(spark, rows):
    frame = spark.range(20000).selectExpr("case when id % 3 > 0 then 'hot' else cast(id as string) end as g", "id")
    top = onboarding.top_values(frame, "g", [F.desc("id")], 2)
    expected = sorted(k for k in range(20000) if k % 3)[-2:]
    assert rows(top.where("g = 'hot'"), "id") == [(k,) for k in expected]
    assert top.count() == 2 + len([k for k in range(20000) if k % 3 == 0])


def test_generated_rows_are_repeatable(spark):
    ddl = "sk bigint, t tinyint, d decimal(6,2), c char(4), v double, dt date, s string"
    one = onboarding.generate_rows(spark, ddl, 50, seed=1, serial=["sk"]).orderBy("sk").collect()
    two = onboarding.generate_rows(spark, ddl, 50, seed=1, serial=["sk"]).repartition(5).orderBy("sk").collect()
    assert one == two and [row["sk"] for row in one] == list(range(1, 51))
    assert all(0 <= row["t"] <= 127 and len(row["c"]) == 4 and len(row["s"]) == 1000 for row in one)
    assert len({row["d"] for row in one}) > 40
    assert onboarding.generate_rows(spark, ddl, 50, seed=2).first()["c"] != one[0]["c"]
    with pytest.raises(ValueError):
        onboarding.generate_rows(spark, "a array<int>", 1)


def test_onboard_feed(spark, rows):
    schema = "o_" + __import__("os").urandom(4).hex()
    spark.sql(f"create schema {schema}")
    try:
        spark.sql(f"create table {schema}.tgt (k int, v varchar(3), job_id int) using parquet")
        spark.sql(f"insert into {schema}.tgt values (0, 'old', 1)")
        feed = spark.createDataFrame([("1", "abc"), ("x", "d"), ("2", None)], "k string, v string")
        result = onboarding.onboard_feed(
            spark, feed, f"{schema}.stg", f"{schema}.tgt", extra={"job_id": 9}, max_issues=1
        )
        assert rows(spark.table(f"{schema}.tgt")) == [(0, "old", 1), (1, "abc", 9), (2, None, 9)]
        assert result.bad.count() == 1
        with pytest.raises(ValueError, match="max issues"):
            onboarding.onboard_feed(spark, feed, f"{schema}.stg", f"{schema}.tgt", extra={"job_id": 9}, max_issues=0)
        onboarding.onboard_feed(spark, feed, f"{schema}.stg", f"{schema}.tgt", extra={"job_id": 9}, dry_run=True)
        assert spark.table(f"{schema}.tgt").count() == 3
    finally:
        spark.sql(f"drop schema {schema} cascade")


def value(spark, column, **cells):
    frame = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{name} string" for name in cells))
    return frame.select(column).first()[0]


@pytest.mark.parametrize(
    "cell, expected",
    [
        ("2020-01-31 1:02:03 PM", "2020-01-31 13:02:03"),
        ("2020-01-31 12:02:03 AM", "2020-01-31 00:02:03"),
        ("2020-01-31 12:02:03 PM", "2020-01-31 12:02:03"),
        ("2020/1/31 1:02pm", "2020-01-31 13:02:00"),
        ("2020-01-31", "2020-01-31 00:00:00"),
        ("2020-01-31 10:20:30", "2020-01-31 10:20:30"),
        ("10:20", None),
        ("not a date at all", None),
    ],
)
def test_ampm(spark, cell, expected):
    found = value(spark, dates.ampm_to_timestamp(F.col("c")), c=cell)
    assert (str(found) if found else None) == expected


@pytest.mark.parametrize(
    "cell, expected",
    [
        ("20200131", "2020-01-31"),
        ("feed_2020-01-31_x", "2020-01-31"),
        ("20200131102030", "2020-01-31 10:20:30"),
        ("2020/01/31 10:20:30", "2020-01-31 10:20:30"),
        ("none", None),
    ],
)
def test_extract_date(spark, cell, expected):
    assert value(spark, dates.normalise_extract_date(F.col("c")), c=cell) == expected


def test_text_expressions(spark):
    assert value(spark, text.encrypt_text(F.col("c")), c="abc") == "ungWv48Bz+pBQUDeXa4iI7ADYaOWF3qctBD/YfIAFa0="
    assert value(spark, text.escape_text(F.col("c"), "\\,"), c="a,b\\") == "a\\,b\\\\"
    assert value(spark, text.fix_code_page(F.col("c")), c="\u0080x\u009f") == "¤x¾"
    assert value(spark, text.replace_text(F.col("c"), ".", "!"), c="a.b") == "a!b"
    frame = spark.createDataFrame([(1, None, "x", 2.5)], "k int, a string, b string, n double")
    assert frame.select(text.concat_columns(frame)).first()[0] == "1x2.5"
    assert text.row_hash(frame, ["k"]).columns == ["k", "hash_value"]
    assert text.safe_identifier("a`b") == "`a``b`"
    none = spark.createDataFrame([(None,)], "c string")
    assert text.text_length(none, "c").first()[0] == 65000
    assert text.text_length(none, "c", "c is not null").first()[0] == 64000


def test_column_helpers(spark):
    assert columns.split_columns(" a, b c ,") == ["A", "BC"]
    assert columns.split_columns(None) == []
    frame = spark.createDataFrame([(1, 2, 3)], "A int, b int, c int")
    assert columns.columns_from_source(frame, ["a", " B "]).columns == ["c"]
    assert columns.optional_filter(frame, None).count() == 1
    assert columns.delta_filter(frame, frame.where("false"), "b").count() == 1
    assert columns.delta_filter(frame, frame, "b").count() == 0


def test_types():
    assert types.number_to_type(2).simpleString() == "tinyint"
    assert types.number_to_type(4).simpleString() == "smallint"
    assert types.number_to_type(9, 0).simpleString() == "int"
    assert types.number_to_type(10).simpleString() == "bigint"
    assert types.number_to_type(12, 3).simpleString() == "decimal(12,3)"
    assert types.nvarchar_to_type(16384).simpleString() == "string"
    assert types.nvarchar_to_type(20).simpleString() == "varchar(20)"
    assert types.varbinary_to_type(51)[0] == "blob" and types.varbinary_to_type(50)[0] == "varbinary"


def test_profile_table_settles_columns_from_sketches(spark, rows, monkeypatch):
    full = []
    monkeypatch.setattr(onboarding, "_value_counts", lambda df, names, least, plain=onboarding._value_counts: full.append(list(names)) or plain(df, names, least))
    frame = spark.range(60_000).selectExpr(
        "id as serial", "cast(id % 3 as string) as few", "case when id % 50 = 0 then 'hot' when id % 7 = 0 then null else cast(id as string) end as mixed",
    )
    found = onboarding.profile_table(frame, values_limit=2)
    assert rows(found, "profiled_field", "value", "count_of_field") == [
        ("few", "0", 20_000), ("few", "1", 20_000), ("mixed", "hot", 1200), ("mixed", None, 8400),
    ]
    assert full == []  # distinct values of no column were shuffled
    # More values are wanted than the sketch can vouch for: that column is counted in full.
    assert rows(onboarding.profile_table(frame, values_limit=5, columns=["mixed"], min_count=0), "value")[:1] == [("0",)] or full == [["mixed"]]
    assert onboarding.profile_table(frame.limit(0)).count() == 0
