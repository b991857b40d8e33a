import datetime
import itertools
import random

import pytest

from feedwright.operators import joins, reconcile, scd
from feedwright.operators.numbering import number_rows

HIGH, OLD = datetime.date(2999, 12, 31), datetime.date(2020, 1, 1)
TARGET = "k int, g string, v string, n double, open_date date, close_date date"
SOURCE = "k int, g string, v string, n double"
DAY = "2024-01-15"


def composed(target, source, keys, **options):
    closable = {key: value for key, value in options.items() if key != "ignore"}
    one = scd.scd2_close_changed(target, source, keys, DAY, **options)
    two = scd.scd2_close_missing(one, source, keys, DAY, **closable)
    return scd.scd2_insert_new(two, source, keys, DAY, **options)


def random_tables(spark, seed, unique):
    rnd = random.Random(seed)
    pool = [(k, g) for k, g in itertools.product([1, 2, 3, None], ["a", "B", "b", None])]
    value = lambda: (rnd.choice(["x", "X", None]), rnd.choice([0.0, -0.0, 1.5, None]))
    pick = (lambda n: rnd.sample(pool, n)) if unique else (lambda n: [rnd.choice(pool) for _ in range(n)])
    target = [(k, g, *value(), OLD, HIGH) for k, g in pick(10)]
    target += [(k, g, *value(), OLD, datetime.date(2021, 1, 1)) for k, g in pick(5)]
    target += [(9, "z", "x", 1.0, OLD, None)]
    source = [(k, g, *value()) for k, g in pick(10)]
    return spark.createDataFrame(target, TARGET), spark.createDataFrame(source, SOURCE)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("folded", [False, True])
def test_apply_equals_composition_with_duplicates_and_nulls(spark, rows, seed, folded):
    target, source = random_tables(spark, seed, unique=False)
    applied = scd.scd2_apply(target, source, ["k", "g"], DAY, case_insensitive=folded)
    assert rows(applied) == rows(composed(target, source, ["k", "g"], case_insensitive=folded))


@pytest.mark.parametrize("seed", range(3))
def test_unique_form_equals_composition(spark, rows, seed):
    target, source = random_tables(spark, seed, unique=True)
    applied = scd.scd2_apply_unique(target, source, ["k", "g"], DAY)
    assert rows(applied) == rows(composed(target, source, ["k", "g"]))


def test_apply_twice_changes_nothing(spark, rows):
    target, source = random_tables(spark, 7, unique=True)
    source = source.where("k is not null and g is not null")
    once = scd.scd2_apply(target, source, ["k", "g"], DAY)
    assert rows(scd.scd2_apply(once, source, ["k", "g"], DAY)) == rows(once)
    open_keys = once.where("close_date = date '2999-12-31' and k is not null and g is not null").groupBy("k", "g").count()
    assert open_keys.where("count > 1").count() == 0


def test_same_day_rerun_may_close_before_open(spark, rows):
    target = spark.createDataFrame([(1, "a", "x", 1.0, datetime.date(2024, 1, 15), HIGH)], TARGET)
    source = spark.createDataFrame([(1, "a", "y", 1.0)], SOURCE)
    closed = scd.scd2_close_changed(target, source, ["k"], DAY)
    assert rows(closed, "open_date", "close_date") == [(datetime.date(2024, 1, 15), datetime.date(2024, 1, 14))]


def test_digest_tells_moved_values_apart(spark, rows):
    target = spark.createDataFrame([(1, None, "x", 1.0, OLD, HIGH)], TARGET)
    source = spark.createDataFrame([(1, "x", None, 1.0)], SOURCE)
    assert scd.scd2_close_changed(target, source, ["k"], DAY).where("close_date < date '2999-12-31'").count() == 1


def test_ignored_and_extra_columns(spark, rows):
    target = spark.createDataFrame([(1, "a", "x", 1.0, OLD, HIGH)], TARGET)
    source = spark.createDataFrame([(1, "a", "changed", 1.0), (2, "b", "y", 2.0)], SOURCE)
    from pyspark.sql import functions as F

    applied = scd.scd2_apply(
        target, source, ["k"], DAY, ignore=["open_date", "close_date", "v"], extra={"v": F.lit("job 7")}
    )
    assert rows(applied, "k", "v", "close_date") == [(1, "x", HIGH), (2, "job 7", HIGH)]
    with pytest.raises(ValueError, match="not in the source"):
        scd.scd2_apply(target, source.drop("v"), ["k"], DAY)


def test_scd1(spark, rows):
    target = spark.createDataFrame([(10, 1, "a"), (11, 2, "b")], "sk int, k int, v string")
    source = spark.createDataFrame([(2, None), (4, "d"), (3, "c"), (None, "n")], "k int, v string")
    inserted = scd.scd1_insert_new(target, source, ["k"], "sk")
    assert rows(inserted) == [(10, 1, "a"), (11, 2, "b"), (12, None, "n"), (13, 3, "c"), (14, 4, "d")]
    assert inserted.schema["sk"].dataType.simpleString() == "int"
    rewritten = scd.scd1_rewrite_changed(target, source, ["k"], "sk")
    assert rows(rewritten) == [(10, 1, "a"), (11, 2, None)]
    empty = target.where("false")
    assert rows(scd.scd1_insert_new(empty, source.where("k = 3"), ["k"], "sk")) == [(1, 3, "c")]


def test_number_rows_is_dense_and_ordered(spark):
    # One value holds most rows.
    frame = spark.range(0, 5000, 1, 16).selectExpr("case when id % 3 > 0 then 7 else id end as k", "id")
    numbered = number_rows(frame, ["k"], "n", 100).collect()
    assert sorted(row["n"] for row in numbered) == list(range(101, 5101))
    by_number = [row["k"] for row in sorted(numbered, key=lambda r: r["n"])]
    assert by_number == sorted(by_number)


def test_unique_keys(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, g string")
    with pytest.raises(ValueError, match="occurs 2 times"):
        joins.assert_unique_keys(frame, ["k", "g"])
    joins.assert_unique_keys(frame.distinct(), ["k", "g"])


def test_reconcile(spark, rows):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (3, None), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, "w"), (None, "n")], "k int, v string")
    assert rows(reconcile.reconcile_tables(a, a, ["k"])) == []
    assert rows(reconcile.reconcile_tables(a, b, ["k"])) == [(2, "different"), (3, "different"), (4, "only_target")]
    assert rows(reconcile.snapshot_diff(b, a, ["k"])) == [(2, "changed"), (3, "changed"), (4, "removed")]


def test_merge_new_columns(spark):
    target = spark.createDataFrame([(1, "a")], "k int, V string")
    assert scd.merge_new_columns(target, spark.createDataFrame([("a",)], "v string")).columns == ["k", "V"]
    merged = scd.merge_new_columns(target, spark.createDataFrame([(1, 2.0)], "k int, w double"))
    assert merged.columns == ["k", "V", "w"] and merged.first()["w"] is None


def test_only_unequal_ranges_are_shuffled(spark, rows):
    a = spark.range(20_000).selectExpr("id as k", "id % 7 as v")
    b = a.selectExpr("k", "case when k in (5, 600) then null else v end as v").where("k <> 9000").union(spark.sql("select 3L, 3L"))
    assert rows(reconcile.reconcile_tables(a, b, ["k"])) == [(3, "different"), (5, "different"), (600, "different"), (9000, "only_source")]
    sides = a.selectExpr("k", "v as d", "true as left").union(b.selectExpr("k", "v as d", "false as left"))
    moved = reconcile.unequal_ranges(sides, "left", ["k"], ["d"])
    assert 8 <= moved.count() <= 30
    assert reconcile.unequal_ranges(sides.where("left").union(sides.where("left").selectExpr("k", "d", "false")), "left", ["k"], ["d"]).count() == 0
    # Rows that only trade places, or occur another number of times, are told apart.
    pairs = spark.createDataFrame([(1, 1, True), (1, 1, True), (1, 2, False), (1, 2, False), (2, 1, True), (2, 1, False), (2, 1, False)], "k int, d int, left boolean")
    assert reconcile.unequal_ranges(pairs, "left", ["k"], ["d"], ranges=1).count() == 7


def test_changed_records_of_repeated_keys(spark, rows):
    target = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, None), (None, "x")], "k int, v string")
    source = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, None), (3, "c"), (None, "y"), (9, "z")], "k long, v string")
    assert rows(joins.changed_records(source, target, ["k"], ["k"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(joins.changed_records(source.selectExpr("k", "upper(v) v"), target, ["k"], ["k"], True)) == [(1, "A"), (2, "B"), (3, "C")]
    assert joins.changed_records(source, target, ["k"], ["k", "v"]).count() == 0
    hot = spark.range(3000).selectExpr("1 as k", "cast(id % 2 as string) as v")
    assert joins.changed_records(hot, hot, ["k"]).count() == 3000


def test_scd1_extra_takes_the_place_of_a_column(spark, rows):
    from pyspark.sql import functions as F

    target = spark.createDataFrame([(10, 1, "a", "old"), (11, 2, "b", "old")], "sk int, k int, v string, note string")
    source = spark.createDataFrame([(1, "x", "s"), (None, "y", "s"), (None, "y", "s")], "k int, v string, note string")
    out = scd.scd1_rewrite_changed(target, source, ["k"], "sk", extra={"note": F.lit("new")})
    assert sorted(out.columns) == ["k", "note", "sk", "v"] and rows(out.select("sk", "k", "v", "note")) == [(10, 1, "x", "new"), (11, 2, "b", "new")]
    with pytest.raises(ValueError, match="duplicate key"):
        scd.scd1_rewrite_changed(target, source.union(source), ["k"], "sk")
