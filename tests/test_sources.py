import os
import random

import pytest
from pyspark.sql import functions as F, types as T

import __spark_entry__ as contract
from feedwright import staging
from feedwright.operators import maintenance, params, runlog
from feedwright.sources import catalog, delimited, jdbc, load, logs, objects, records


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as handle:
        handle.write(text)
    return str(path)


@pytest.fixture
def schema(spark):
    name = "t_" + os.urandom(4).hex()
    spark.sql(f"create schema {name}")
    yield name
    spark.sql(f"drop schema {name} cascade")


def test_read_delimited_blank_and_null_text(spark, rows, tmp_path):
    path = write(f"{tmp_path}/a.csv", 'a,b\n"x",\\N\n"",y\n')
    assert rows(delimited.read_delimited(spark, path, null_value="\\N")) == [("x", None), (None, "y")]
    tabbed = write(f"{tmp_path}/b.tsv", "1\t2\n")
    assert delimited.read_delimited(spark, tabbed, sep="\\t", header=False).columns == ["COLUMN_1", "COLUMN_2"]


def test_skip_leading_rows_over_many_splits(spark, rows, tmp_path):
    lines = ["garbage", "more", "k,v"] + [f"{k},v{k}" for k in range(2000)]
    path = write(f"{tmp_path}/in/a.csv", "\n".join(lines) + "\n")
    write(f"{tmp_path}/in/b.csv", "g1\ng2\nk,v\n-1,only\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        frame = delimited.skip_leading_rows(spark, f"{tmp_path}/in", 3, ["k", "v"])
        assert sorted(int(row["k"]) for row in frame.collect()) == list(range(-1, 2000))
        numbered = delimited.number_lines(spark, path)
        assert rows(numbered.where("value = '1500,v1500'"), "line_no") == [(1504,)]
        assert numbered.select(F.countDistinct("line_no"), F.max("line_no")).first() == (2003, 2003)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_headings_verbatim(spark, rows, tmp_path):
    path = write(f"{tmp_path}/d.csv", 'x"1,\n')
    write(path + ".headers", "a,b\n")
    assert rows(delimited.read_csv_with_headings_file(spark, path, verbatim=True)) == [('x"1', None)]


def test_table_from_string(spark, rows):
    frame = delimited.table_from_string(spark, "na me|value\n a | 1\nb|", "|")
    assert frame.columns == ["name", "value"] and rows(frame) == [("a", "1"), ("b", "")]


def test_raw_export_has_no_quotes(spark, tmp_path):
    frame = spark.createDataFrame([('a"b', "c d", None)], "x string, y string, z string")
    delimited.write_csv(frame.coalesce(1), f"{tmp_path}/raw", raw=True)
    text = "".join(row["value"] + "\n" for row in spark.read.text(f"{tmp_path}/raw").collect())
    assert text == 'X,Y,Z\na"b,c d,\\N\n'


def test_list_objects(spark, rows, tmp_path):
    write(f"{tmp_path}/a/one.txt", "123")
    write(f"{tmp_path}/a/b/two.txt", "12345")
    write(f"{tmp_path}/c/three.txt", "1")
    found = objects.list_objects(spark, str(tmp_path), prefix="a/")
    assert rows(found, "file", "size") == [("one.txt", 3), ("two.txt", 5)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_log_lines(spark, rows):
    lines = spark.createDataFrame([("12 ok",), ("#x",), ("bad",), ("7 ",)], "value string")
    good, bad, counts = logs.parse_log_lines(lines, r"(\d+) (\w+)?", ["n", "w"], "^#", optional_groups=[2])
    assert rows(good) == [("12", "ok"), ("7", None)] and rows(bad) == [("bad",)]
    assert rows(counts) == [(4, 2, 1, 1)]
    with pytest.raises(ValueError, match="maximum parse errors"):
        logs.parse_log_lines(lines, r"(\d+)", error_state_regex="^#", max_parse_errors=0)
    assert rows(logs.parse_log_lines(lines, "ok")[0]) == [("1",)]


def test_load_file(spark, rows, schema, tmp_path):
    ddl = T.StructType.fromDDL("k int, d date, t string")
    path = write(f"{tmp_path}/l.csv", "k;d;t\n1;31/12/2020;a\nx;01/01/2021;b\n2;1/2/2021;c\n3;1/2/2021\n4;1/2/2021;d;e\n")
    table = f"{schema}.loaded"
    options = {"sep": ";", "header": True, "date_style": "DMY", "date_delim": "/"}
    with pytest.raises(ValueError, match="3 bad records"):
        load.load_file(spark, path, table, ddl, **options)
    assert not spark.catalog.tableExists(table)
    assert rows(load.load_file(spark, path, table, ddl, max_bad=3, **options)) == [(2, 3)]
    assert [str(row["d"]) for row in spark.table(table).orderBy("k").collect()] == ["2020-12-31", "2021-02-01"]
    with pytest.raises(ValueError, match="not empty"):
        load.load_file(spark, path, table, max_bad=3, **options)
    load.load_file(spark, path, table, max_bad=3, write="append", **options)
    assert spark.table(table).count() == 4
    load.load_file(spark, path, table, max_bad=3, write="overwrite", jagged=True, ignore_unknown=True, **options)
    assert spark.table(table).count() == 4
    with pytest.raises(ValueError, match="does not exist"):
        load.load_file(spark, path, f"{schema}.absent", ddl, create=False)


def test_load_json_and_skip(spark, rows, schema, tmp_path):
    ddl = T.StructType.fromDDL("k int, t string")
    path = write(f"{tmp_path}/l.json", '{"k":1,"t":"a"}\n{"k":2,"t":"b","u":1}\n{"k":"x","t":"c"}\nbroken\n')
    table = f"{schema}.js"
    assert rows(load.load_file(spark, path, table, ddl, max_bad=3, preset="warehouse_json")) == [(1, 3)]
    counts = load.load_file(
        spark, path, table, ddl, max_bad=2, write="overwrite", preset="warehouse_json", ignore_unknown=True
    )
    assert rows(counts) == [(2, 2)]
    skipped = write(f"{tmp_path}/s.csv", "note\nk,t\n5,e\n")
    assert rows(load.load_file(spark, skipped, f"{schema}.sk", ddl, skip_rows=2)) == [(1, 0)]


def test_publish_swaps_and_restores(spark, rows, schema):
    table = f"{schema}.dim"
    spark.range(3).write.saveAsTable(table)
    catalog.publish(spark, {table: spark.table(table).where("id > 0")})
    assert rows(spark.table(table)) == [(1,), (2,)]
    broken = spark.range(1).select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    with pytest.raises(Exception, match="no"):
        catalog.publish(spark, {table: spark.range(9).toDF("id"), f"{schema}.other": broken})
    assert rows(spark.table(table)) == [(1,), (2,)]
    assert [t.name for t in spark.catalog.listTables(schema) if not t.isTemporary] == ["dim"]
    catalog.publish(spark, {table: spark.range(9).toDF("id")}, dry_run=True)
    assert spark.table(table).count() == 2


class Died(BaseException):
    pass


def test_publish_that_dies_between_any_two_swaps(spark, rows, schema, monkeypatch):
    a, b, plain = f"{schema}.a", f"{schema}.b", type(spark).sql
    spark.range(1).selectExpr("id", "id % 2 as p").write.partitionBy("p").saveAsTable(a)
    for last in range(1, 4):  # b is new at first
        renames = 3 if last == 1 else 4
        for step in range(renames + 1):
            seen = []

            def sql(self, text, *args, **more):
                if text.startswith("ALTER TABLE") and "RENAME" in text:
                    seen.append(text)
                    if len(seen) == step + 1:
                        raise Died
                return plain(self, text, *args, **more)

            new = spark.range(last * 10 + step).selectExpr("id", "id % 2 as p")
            monkeypatch.setattr(type(spark), "sql", sql)
            if step < renames:
                with pytest.raises(Died):
                    catalog.publish(spark, {a: new, b: new})
            else:
                catalog.publish(spark, {a: new, b: new})
            monkeypatch.setattr(type(spark), "sql", plain)
            # Committed: readers that ask see both new tables, whatever was swapped.
            assert [catalog.published_table(spark, name).count() for name in (a, b)] == [last * 10 + step] * 2
            assert catalog.recover_publications(spark) == {}  # it may be at work still
            assert list(catalog.recover_publications(spark, 0).values()) == ["finished"] * (step < renames)
            assert [spark.table(name).count() for name in (a, b)] == [last * 10 + step] * 2
            assert sorted(t.name for t in spark.catalog.listTables(schema) if not t.isTemporary) == ["a", "b"]
            if last == 1:
                catalog.drop_table(spark, b)
                if step == renames:
                    spark.range(1).selectExpr("id", "id % 2 as p").write.saveAsTable(b)


def test_publish_that_dies_before_its_commit(spark, rows, schema, monkeypatch):
    a = f"{schema}.a"
    spark.range(3).write.saveAsTable(a)

    def die(self, name):
        raise Died

    monkeypatch.setattr(catalog._Intents, "commit", die)
    with pytest.raises(Died):
        catalog.publish(spark, {a: spark.range(7).toDF("id")})
    assert catalog.published_table(spark, a).count() == 3 == spark.table(a).count()
    assert list(catalog.recover_publications(spark, 0).values()) == ["undone"]
    assert [t.name for t in spark.catalog.listTables(schema) if not t.isTemporary] == ["a"]
    monkeypatch.undo()
    catalog.publish(spark, {a: spark.range(7).toDF("id")})
    assert spark.table(a).count() == 7


def test_publish_keeps_the_layout(spark, rows, schema):
    table = f"{schema}.parts"
    frame = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c d/e'"), (4, None)], "id int, v string")
    frame.write.partitionBy("v").saveAsTable(table)
    spark.sql(f"alter table {table} set tblproperties ('owner_team' = 'it''s us')")
    parts = lambda name: [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    owner = lambda: {r["key"]: r["value"] for r in spark.sql(f"show tblproperties {table}").collect()}.get("owner_team")
    catalog.publish(spark, {table: spark.table(table).where("id > 1")})
    assert (rows(spark.table(table), "id", "v"), parts(table), owner()) == ([(2, "b"), (3, "c d/e'"), (4, None)], ["v"], "it's us")
    catalog.publish(spark, {table: frame.withColumn("more", F.lit(1))})
    assert (spark.table(table).count(), parts(table), owner()) == (4, ["v"], "it's us")
    catalog.publish_partitions(spark, table, spark.table(table).where("v = 'a'").withColumn("id", F.lit(7)))
    assert rows(spark.table(table), "id", "v") == [(2, "b"), (3, "c d/e'"), (4, None), (7, "a")]
    bucketed = f"{schema}.bucketed"
    frame.write.bucketBy(3, "id").saveAsTable(bucketed)
    catalog.publish(spark, {bucketed: frame})
    assert "Num Buckets" in {r["col_name"] for r in spark.sql(f"describe extended {bucketed}").collect()}
    assert spark.table(bucketed).count() == 4


def test_catalog(spark, rows, schema):
    spark.createDataFrame([(1, "a")], "k int, v string").write.saveAsTable(f"{schema}.src")
    assert catalog.create_if_missing(spark, f"{schema}.copy", f"{schema}.src")
    assert not catalog.create_if_missing(spark, f"{schema}.copy", f"{schema}.src")
    assert spark.table(f"{schema}.copy").count() == 0
    catalog.table_from_sql(spark, f"select k + 1 as k, v from {schema}.src", f"{schema}.made")
    assert rows(spark.table(f"{schema}.made")) == [(2, "a")]
    catalog.truncate_table(spark, f"{schema}.made")
    assert spark.table(f"{schema}.made").count() == 0
    assert catalog.clone_schema(spark, schema, schema + "_c") == ["copy", "made", "src"]
    spark.sql(f"drop schema {schema}_c cascade")
    assert catalog.drop_tables_like(spark, schema, "^(copy|made)$") == ["copy", "made"]
    assert catalog.schema_missing(spark, "no_such_schema") and catalog.table_exists(spark, f"{schema}.src")
    described = catalog.describe_table(spark.sql("select cast(1 as decimal(9,2)) as b, 'x' as a"), sort=True)
    assert rows(described, "column_name", "data_type", "precision") == [("a", "string", None), ("b", "decimal", "(9,2)")]
    ddl = catalog.ddl_from_schema(spark.table(f"{schema}.src").schema, f"{schema}.x")
    assert ddl == f"CREATE TABLE `{schema}`.`x` (`k` int, `v` string)"
    maintenance.write_distributed(spark.range(10).toDF("k"), f"{schema}.buckets", ["k"], 4)
    assert spark.table(f"{schema}.buckets").count() == 10


def test_external_csv(spark, rows, schema, tmp_path):
    write(f"{tmp_path}/ext/part.csv", "7|x|2020-01-31\n")
    delimited.create_external_csv(
        spark, f"{schema}.ext", f"{tmp_path}/ext", ["n", "t", "d"], {"n": "INTEGER", "d": "DATE"}, sep="|"
    )
    row = spark.table(f"{schema}.ext").first()
    assert row["n"] == 7 and str(row["d"]) == "2020-01-31"


def test_jdbc_options():
    assert jdbc.jdbc_url("postgres", "db", "h") == "jdbc:postgresql://h:5432/db"
    assert jdbc.jdbc_url("sqlite", "/tmp/x.db") == "jdbc:sqlite:/tmp/x.db"
    assert jdbc.jdbc_options("u", query="select 1")["query"] == "select 1"
    split = jdbc.jdbc_options("u", query="select 1", partition_column="k", lower=0, upper=9, partitions=3)
    assert split["dbtable"] == "(select 1) src" and split["numPartitions"] == "3" and "query" not in split
    with pytest.raises(ValueError):
        jdbc.jdbc_options("u")
    with pytest.raises(ValueError):
        jdbc.jdbc_options("u", table="t", partition_column="k")


def test_delete_and_update(spark, rows):
    frame = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, v string")
    assert rows(maintenance.delete_rows(frame, "where v = 'a'"), "k") == [(2,), (3,)]
    assert maintenance.delete_rows(frame).count() == 0
    assert rows(maintenance.update_rows(frame, "v = 'a'", {"v": "z"}), "v") == [("b",), ("z",), (None,)]


def test_params_and_audit(spark, rows, tmp_path):
    assert params.query_params(spark.sql("select 1 as `max sk`, 'x' as t")) == {"max_sk": 1, "t": "x"}
    assert params.query_params(spark.range(0)) == {}
    looped = params.for_each_row(spark.range(5), lambda row: spark.range(row["id"], row["id"] + 1), branches=2)
    assert rows(looped) == [(k,) for k in range(5)]
    assert params.for_each_row(spark.range(0), lambda row: spark.range(1)) is None
    counted, seen = runlog.affected_rows(spark.range(7))
    counted.write.format("noop").mode("overwrite").save()
    assert seen.get["rows_affected"] == 7
    log = f"{tmp_path}/log"
    with runlog.step_audit(spark, log, 1, "nightly", 10, "SQL") as facts:
        facts["rows_affected"] = 7
    with pytest.raises(RuntimeError):
        with runlog.step_audit(spark, log, 1, "nightly", 20, "SQL"):
            raise RuntimeError("step failed")
    logged = spark.read.parquet(log)
    assert rows(logged, "sequence_order", "execution_sts", "rows_affected") == [(10, "COMPLETE", 7), (20, "ERROR", None)]


def test_headers_in_another_order_are_read_by_name(spark, rows, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,2\n")
    (folder / "2.csv").write_text("b,a\n3,4\n")
    assert rows(delimited.read_delimited(spark, str(folder)), "a", "b") == [("1", "2"), ("4", "3")]
    (folder / "3.csv").write_text("b,c\n3,4\n")
    with pytest.raises(ValueError, match="header rows differ"):
        delimited.read_delimited(spark, str(folder))


QUOTED = [
    'a,"b"', '"x\ny",2', 'plain,"two ""doubled"""', 'loose "quote" inside,3', '"last\n\nopen\n,comma",4', ",", '"",""', '"q","r\n"', "e f,5",
]


@pytest.mark.parametrize("escape", ['"', "\\"])
def test_quoted_newlines_over_many_splits_equal_one_task(spark, rows, tmp_path, escape):
    rng = random.Random(3)
    for name in ("1", "2"):
        lines = ["k,v", *[rng.choice(QUOTED) for _ in range(300)]]
        if escape == "\\":
            lines = [line.replace('""doubled""', '\\"escaped\\"') for line in lines]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    whole = spark.read.options(multiLine=True, escape=escape, header=True, quote='"').schema("k string, v string").csv(f"{tmp_path}/*.csv")
    want = rows(whole.selectExpr("nullif(k, '') k", "nullif(v, '') v"))
    sizes = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("97", "400", sizes):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            frame = delimited.read_delimited(spark, f"{tmp_path}/*.csv", escape=escape, multiline=True)
            assert rows(frame, "k", "v") == want
            assert size == sizes or frame.rdd.getNumPartitions() > 8
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", sizes)


def test_leading_rows_with_all_options(spark, rows, tmp_path):
    text = "garbage \" here\nk;v\n1;\"two\nlines\"\n2;\u00e4\n"
    (tmp_path / "one.csv").write_bytes(text.encode("latin-1"))
    frame = delimited.skip_leading_rows(spark, str(tmp_path / "one.csv"), 2, ["k", "v"], sep=";", encoding="latin1", multiline=True)
    assert rows(frame) == [("1", "two\nlines"), ("2", "\u00e4")]
    (tmp_path / "two.csv").write_text('x\n1,"a\n2,b"c"\n')
    assert rows(delimited.skip_leading_rows(spark, str(tmp_path / "two.csv"), 1, ["k", "v"], quote=None)) == [("1", '"a'), ("2", 'b"c"')]
    (tmp_path / "three.csv").write_text("junk|k,v|1,2|3,4")
    assert rows(delimited.skip_leading_rows(spark, str(tmp_path / "three.csv"), 1, ["k", "v"], eol="|")) == [("1", "2"), ("3", "4"), ("k", "v")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5")
    try:
        with pytest.raises(Exception, match="beyond its first split"):
            delimited.skip_leading_rows(spark, str(tmp_path / "one.csv"), 3, ["k", "v"]).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_first_lines_reads_heads_only(spark, rows, tmp_path):
    import gzip

    (tmp_path / "long").write_text("x" * 200_000 + "\nrest\n" * 10)
    (tmp_path / "no_end").write_text("abc")
    (tmp_path / "empty").write_text("")
    (tmp_path / "blank").write_text("\n\n")
    (tmp_path / "zipped.gz").write_bytes(gzip.compress(b"12345\r\n6"))
    found = records.first_lines(spark, str(tmp_path)).selectExpr("regexp_extract(path, '[^/]*$', 0) f", "length(line) n")
    assert rows(found) == [("blank", 0), ("long", 200_000), ("no_end", 3), ("zipped.gz", 5)]


def test_listed_folders_are_written_by_as_many_tasks_as_their_rows_need(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(maintenance, "ROWS_PER_PARTITION", 100, raising=False)
    events = [(key, "click" if key < 990 else None) for key in range(1000)]
    spark.createDataFrame(events, "event_id bigint, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    staged = len(staging._made)
    listed = contract.queries()["list_objects"](spark, str(tmp_path))
    assert rows(listed, "folder", "n_files", "n_lines") == [("type=__HIVE_DEFAULT_PARTITION__", 3, 10), ("type=click", 3, 990)]
    # The files of one task are named by it; 330 lines of a folder no longer meet in one.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{staging._made[staged]}/day=1")
    task = F.regexp_extract("path", "part-([0-9]+)-", 1).alias("task")
    assert files.groupBy(task).agg((F.sum("length") / 2).alias("n")).agg(F.max("n")).first()[0] <= 110


def test_keys_are_dealt_to_as_many_tasks_as_the_rows_need(spark, rows, monkeypatch):
    monkeypatch.setattr(maintenance, "ROWS_PER_PARTITION", 1000, raising=False)
    df = spark.range(30_000).selectExpr("id", "id % 3 as k")
    sizes = [n for _, n in rows(maintenance.distribute_by_keys(df, primary=["id"]).groupBy(F.spark_partition_id()).count())]
    assert sum(sizes) == 30_000 and len(sizes) == 30 and max(sizes) < 1200
    # Rows of a key stay together; a given number holds; small tables still use every core.
    dealt = maintenance.distribute_by_keys(df, declared=["k"]).select("k", F.spark_partition_id().alias("p")).distinct()
    assert dealt.count() == 3
    assert maintenance.distribute_by_keys(df, primary=["id"], partitions=5).rdd.getNumPartitions() == 5
    assert maintenance.distribute_by_keys(df.limit(10), primary=["id"]).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert maintenance.distribute_by_keys(df.limit(0), primary=["id"]).count() == 0


def test_list_objects_lists_below_the_prefix_only(spark, rows, tmp_path):
    for name in ("a/1.csv", "ab/2.csv", "b/3.csv", "a[1]/4.csv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert rows(objects.list_objects(spark, str(tmp_path), prefix="a"), "file") == [("1.csv",), ("2.csv",), ("4.csv",)]
    assert rows(objects.list_objects(spark, str(tmp_path), prefix="a[1]/"), "file") == [("4.csv",)]
    assert rows(objects.list_objects(spark, str(tmp_path), prefix="a/", pattern="9*"), "file") == []
    assert rows(objects.list_objects(spark, str(tmp_path), prefix="none/"), "file") == []
