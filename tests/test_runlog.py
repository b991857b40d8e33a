import datetime
import os

import pytest
from pyspark.sql import Row, functions as F

import __spark_entry__ as contract
from feedwright.operators import hierarchy, runlog
from feedwright.staging import stage
from feedwright.streaming import harvest

LINKS = "node bigint, next bigint"


def test_chain_of_many_steps(spark, rows):
    links = spark.range(100).selectExpr("id as node", "id - 1 as next")
    ends = hierarchy.chain_ends(links)
    assert rows(ends) == sorted([(k, 0, k) for k in range(100)], key=repr)


def test_cycles(spark, rows):
    links = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, None), (5, 4), (6, 6)], LINKS)
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.chain_ends(links)
    found = hierarchy.chain_ends(links, on_cycle="null")
    assert rows(found, "node", "end") == [(1, None), (2, None), (3, None), (4, 4), (5, 4), (6, None)]


def test_step_tree_levels(spark, rows):
    config = spark.createDataFrame(
        [("g", 1, 0, "A", 0), ("g", 2, 1, "B", 1), ("g", 3, 2, "C", 0), ("g", 4, 0, "D", 0), ("h", 9, 0, "E", 0)],
        "processing_group_name string, sequence_order bigint, parent_sequence_order bigint, template_name string, "
        "disable_flag int",
    )
    tree = hierarchy.step_tree(config, "g")
    assert [tuple(row) for row in tree.collect()] == [(1, 0, "A", 1), (3, 2, "C", 3), (4, 0, "D", 1)]
    assert rows(hierarchy.step_tree(config, "g", root=1), "sequence_order", "recursion_level") == [(3, 2)]


def test_root_blocker(spark, rows):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (5, 6), (6, 5)], "waiting bigint, blocking bigint")
    assert rows(hierarchy.root_blocker(edges)) == [
        (1, 2, 3, 2),
        (2, 3, 3, 1),
        (4, 3, 3, 1),
        (5, 6, None, None),
        (6, 5, None, None),
    ]
    several = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (2, 5), (3, 5)], "waiting bigint, blocking bigint")
    assert rows(hierarchy.root_blocker(several)) == [
        (1, 2, 4, 2),
        (1, 2, 5, 2),
        (1, 3, 5, 2),
        (2, 4, 4, 1),
        (2, 5, 5, 1),
        (3, 5, 5, 1),
    ]


def test_root_blocker_of_chains_and_cycles(spark, rows, monkeypatch):
    written = []
    monkeypatch.setattr(hierarchy, "stage", lambda df, label: written.append(stage(df, label)) or written[-1])
    chain = spark.createDataFrame([(k, k + 1) for k in range(64)], "waiting bigint, blocking bigint")
    found = hierarchy.root_blocker(chain)
    assert rows(found) == sorted(((k, k + 1, 64, 64 - k) for k in range(64)), key=repr)
    # Six doublings, and never more than one pointer per process.
    assert len(written) == 8 and max(frame.count() for frame in written) <= 64
    # A cycle of three with a way out, two ways of different length to one root.
    mixed = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 9), (5, 9), (5, 6), (6, 9), (7, 7)], "waiting bigint, blocking bigint")
    assert rows(hierarchy.root_blocker(mixed)) == [
        (1, 2, 9, 3), (2, 3, 9, 2), (3, 1, 9, 4), (3, 9, 9, 1), (5, 6, 9, 2), (5, 9, 9, 1), (6, 9, 9, 1), (7, 7, None, None),
    ]


def test_text_parts(spark, rows):
    frame = spark.createDataFrame([(1, "abcdef"), (2, ""), (3, "abcd")], "id int, text string")
    parts = runlog.split_text_parts(frame, "text", 3)
    assert rows(parts.where("id = 1"), "part_sequence", "part_text") == [(1, "abc"), (2, "def"), (3, "")]
    assert rows(runlog.reassemble_text(parts, ["id"])) == rows(frame)


def test_batch_filters(spark):
    moment = datetime.datetime(2024, 1, 10)
    batches = spark.createDataFrame(
        [(k, "g", moment - datetime.timedelta(days=k), moment, "COMPLETE", 1) for k in range(10)],
        "batch_id bigint, batch_identifier string, start_ts timestamp, end_ts timestamp, status string, "
        "processing_time bigint",
    )
    jobs = spark.createDataFrame(
        [],
        "job_id bigint, batch_id bigint, identifier string, start_ts timestamp, end_ts timestamp, status string, "
        "processing_time bigint",
    )
    assert runlog.batch_jobs(batches, jobs, ids=[1, 2]).count() == 2
    assert runlog.batch_jobs(batches, jobs, days=7, now=F.lit(moment)).count() == 8
    assert sorted(row["batch_id"] for row in runlog.batch_jobs(batches, jobs, limit=3).collect()) == [7, 8, 9]
    many = spark.range(1500).select(F.col("id").alias("batch_id")).join(batches.drop("batch_id").limit(1))
    assert runlog.batch_jobs(many, jobs).count() == 1500


CONTROL_SCHEMA = (
    "file_regex string, processing_group_name string, pos_1 string, pos_2 string, record_length bigint, "
    "perform_load_order_check int"
)


def control(spark, *rows):
    return spark.createDataFrame(list(rows), CONTROL_SCHEMA)


def test_patterns(spark, rows):
    feeds = control(
        spark,
        (r"sales_(\d+)", "sales", "EXTRACT_DATE", None, None, 0),
        (r"sales", "any_sales", "WHOLE", None, None, 0),
        (r"fixed", "fixed_9", None, None, 9, 1),
        (r"fixed(_x)?", "fixed_other", "SUFFIX", None, None, 0),
    )
    files = spark.createDataFrame(
        [("SALES_20200101.csv", 1), ("fixed.dat", 9), ("fixed.dat2", 8), ("other", 1)], "file string, first_line_length int"
    )
    matched = harvest.match_file_patterns(files, feeds)
    found = {row["file"]: (row["processing_group_name"], row["attributes"]) for row in matched.collect()}
    assert found == {
        "SALES_20200101.csv": ("any_sales", {"WHOLE": "1"}),
        "fixed.dat": ("fixed_9", {}),
        "fixed.dat2": ("fixed_other", {"SUFFIX": None}),
    }
    assert harvest.match_file_patterns(files, []).count() == 0


def test_missing_date_is_an_error_when_order_matters(spark):
    files = spark.createDataFrame([("sales_x.csv",)], "file string")
    strict = control(spark, (r"sales_(\w)", "s", "EXTRACT_DATE", None, None, 1))
    with pytest.raises(Exception, match="no extract date"):
        harvest.order_by_extract_date(harvest.match_file_patterns(files, strict)).collect()
    lax = control(spark, (r"sales_(\w)", "s", "EXTRACT_DATE", None, None, 0))
    assert harvest.order_by_extract_date(harvest.match_file_patterns(files, lax), F.lit("now")).first()["extract_date"] == "now"


def test_load_gap(spark, rows):
    day = datetime.date
    log = spark.createDataFrame(
        [
            ("a", 1, day(2024, 1, 1), "COMPLETE"),
            ("a", 2, day(2024, 1, 2), "COMPLETE"),
            ("a", 3, day(2024, 1, 4), "ERROR"),
            ("b", 4, day(2024, 1, 1), "ERROR"),
        ],
        "processing_group_name string, job_id int, extract_ts date, status string",
    )
    files = spark.createDataFrame(
        [("a", day(2024, 1, 1)), ("a", day(2024, 1, 3)), ("a", day(2024, 1, 4)), ("a", day(2024, 1, 5)), ("b", day(2024, 1, 2))],
        "processing_group_name string, extract_ts date",
    )
    assert rows(harvest.load_gap(log, files), "processing_group_name", "extract_ts", "verdict") == [
        ("a", day(2024, 1, 1), "ERROR_OLDER"),
        ("a", day(2024, 1, 3), "OK"),
        ("a", day(2024, 1, 4), "WARNING_GAP"),
        ("a", day(2024, 1, 5), "ERROR_GAP"),
        ("b", day(2024, 1, 2), "FIRST"),
    ]


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as handle:
        handle.write(text)


def harvester(spark, tmp_path, feeds, handler=None, incoming="incoming"):
    """(seen, run): what handlers were called with, and a function that runs the harvest."""
    seen = []

    def record(session, date, files, batch_id):
        seen.append((date, [row["file"] for row in files]))
        if handler:
            handler(session, date, files, batch_id)

    def run(control_rows=feeds, **options):
        return harvest.harvest_stream(
            spark, str(tmp_path / incoming), control_rows, str(tmp_path / "checkpoint"), record, str(tmp_path / "log"), **options
        )

    return seen, run


def test_load_order_of_feeds_with_runs_past_2038(spark, rows, tmp_path):
    # Feed 0 has so many days that their seconds do not fit an int.
    customers = [(0, 24_900), (1, 3), (2, 4), (3, 5), (26, 2)]
    orders = [(key, customer) for customer, n in customers for key in range(n)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    judged = contract.queries()["check_load_order"](spark, str(tmp_path))
    assert rows(judged) == [("feed_0", "OK", False), ("feed_1", "ERROR_OLDER", True), ("feed_2", "ERROR_GAP", True), ("feed_3", "WARNING_GAP", False)]


def test_harvest_runs_in_date_order_and_once(spark, rows, tmp_path):
    incoming, out = str(tmp_path / "incoming"), str(tmp_path / "out")
    put(incoming, "sales_20240102.csv", "k,v\n1,a\nx,b\n")
    put(incoming, "sales_20240101.csv", "k,v\n2,c\n")
    put(incoming, "readme.txt", "not a feed")
    feeds = control(spark, (r"sales_(\d+)", "sales", "EXTRACT_DATE", None, None, 1))
    sink = harvest.harvest_datacop({"sales": "k int, v varchar(3)"}, out)
    seen, run = harvester(spark, tmp_path, feeds, sink)
    assert rows(run(), "file", "status") == [("sales_20240101.csv", "COMPLETE"), ("sales_20240102.csv", "COMPLETE")]
    assert seen == [("2024-01-01", ["sales_20240101.csv"]), ("2024-01-02", ["sales_20240102.csv"])]
    assert run().count() == 0 and len(seen) == 2
    good = spark.read.option("header", True).csv(f"{out}/good")
    bad = spark.read.option("header", True).csv(f"{out}/bad")
    assert rows(good, "k", "v") == [("1", "a"), ("2", "c")]
    assert rows(bad, "k", "v") == [("x", "b")]
    log = harvest.read_log(spark, str(tmp_path / "log"))
    assert rows(log, "identifier", "status") == [("sales_20240101.csv", "COMPLETE"), ("sales_20240102.csv", "COMPLETE")]
    put(incoming, "sales_20231231.csv", "k,v\n9,z\n")
    with pytest.raises(ValueError, match="load order"):
        run()


def test_harvest_order_does_not_depend_on_arrival_or_batches(spark, rows, tmp_path):
    incoming = str(tmp_path / "incoming")
    for age, name in enumerate(["sales_20240101.csv", "sales_20240102.csv", "sales_20240103.csv"]):
        put(incoming, name, "k\n1\n")
        os.utime(os.path.join(incoming, name), (1_700_000_000 - age * 1000,) * 2)
    feeds = control(spark, (r"sales_(\d+)", "sales", "EXTRACT_DATE", None, None, 1))
    seen, run = harvester(spark, tmp_path, feeds)
    first = run(max_files=1)
    assert [date for date, _ in seen] == ["2024-01-01", "2024-01-02", "2024-01-03"]
    put(incoming, "sales_20240104.csv", "k\n1\n")
    second = run(max_files=7)
    assert first.agg(F.max("job_id")).first()[0] < second.agg(F.min("job_id")).first()[0]
    # The order was checked before each date: each one followed the one before it.
    put(incoming, "sales_20240106.csv", "k\n1\n")
    run()
    put(incoming, "sales_20240105.csv", "k\n1\n")
    with pytest.raises(ValueError, match="ERROR_OLDER"):
        run()
    assert len(seen) == 5


def test_a_gap_with_a_failed_run_in_it_raises(spark, rows, tmp_path):
    incoming = str(tmp_path / "incoming")
    feeds = control(spark, (r"sales_(\d+)", "sales", "EXTRACT_DATE", None, None, 1))

    def handler(session, date, files, batch_id):
        if date == "2024-01-02":
            raise RuntimeError("handler failed")

    seen, run = harvester(spark, tmp_path, feeds, handler)
    for day in (1, 2, 4):
        put(incoming, f"sales_2024010{day}.csv", "k\n1\n")
    with pytest.raises(RuntimeError, match="handler failed"):
        run()
    log = harvest.read_log(spark, str(tmp_path / "log"))
    assert rows(log, "identifier", "status") == [("sales_20240101.csv", "COMPLETE"), ("sales_20240102.csv", "ERROR")]
    os.remove(os.path.join(incoming, "sales_20240102.csv"))
    only = control(spark, (r"sales_(2024010[14])", "sales", "EXTRACT_DATE", None, None, 1))
    with pytest.raises(ValueError, match="ERROR_GAP"):
        run(only)


def test_no_file_is_lost(spark, rows, tmp_path):
    incoming = str(tmp_path / "incoming")
    put(incoming, "sales_20240101.csv", "k\n1\n")
    put(incoming, "stock_20240101.csv", "k\n1\n")
    sales = control(spark, (r"sales_(\d+)", "sales", "EXTRACT_DATE", None, None, 0))
    both = control(spark, (r"sales_(\d+)", "sales", "EXTRACT_DATE", None, None, 0), (r"stock_", "stock", None, None, None, 0))
    seen, run = harvester(spark, tmp_path, sales)
    # A dry run plans, and changes nothing.
    assert rows(run(dry_run=True), "file", "status") == [("sales_20240101.csv", "PLANNED")]
    assert seen == [] and not (tmp_path / "checkpoint").exists() and not (tmp_path / "log").exists()
    # A file in flight waits, and comes back.
    busy = [(1, "sales", "sales_20240101.csv", "elsewhere", "2024-01-01", "RUNNING")]
    harvest.write_log(spark, str(tmp_path / "log"), 1, busy)
    assert run().count() == 0 and seen == []
    harvest.write_log(spark, str(tmp_path / "log"), 1, [(*busy[0][:-1], "ERROR")])
    assert rows(run(archive=str(tmp_path / "done")), "file") == [("sales_20240101.csv",)]
    assert os.listdir(tmp_path / "done") == ["sales_20240101.csv"]
    # A file that matched no feed is there for the right pattern.
    assert rows(run(both), "file") == [("stock_20240101.csv",)]


def test_groups_of_feeds(spark, rows, tmp_path):
    put(str(tmp_path / "incoming"), "a_1.csv", "k\n")
    put(str(tmp_path / "incoming"), "b_1.csv", "k\n")
    feeds = control(spark, ("a_", "a", None, None, None, 0), ("b_", "b", None, None, None, 0)).withColumn(
        "grouping_code", F.col("processing_group_name")
    )
    seen, run = harvester(spark, tmp_path, feeds)
    assert rows(run(group="b"), "file") == [("b_1.csv",)]
    assert rows(run(), "file") == [("a_1.csv",)]


def test_harvest_record_length(spark, rows, tmp_path):
    incoming = str(tmp_path / "incoming")
    put(incoming, "fixed_a.dat", "123456789\n1\n")
    put(incoming, "fixed_b.dat", "1234\n123456789\n")
    put(incoming, "other.txt", "12")
    feeds = control(spark, (r"fixed", "nine", None, None, 9, 0), (r"fixed_", "four", None, None, 4, 0))
    seen, run = harvester(spark, tmp_path, feeds)
    assert rows(run(), "processing_group_name", "file") == [("four", "fixed_b.dat"), ("nine", "fixed_a.dat")]


def test_positions_past_fifteen(spark):
    row = Row(file_regex="".join(r"(\w)" for _ in range(20)), processing_group_name="g", **{f"pos_{k}": f"p{k}" for k in range(1, 21)})
    files = spark.createDataFrame([("abcdefghijklmnopqrst",)], "file string")
    assert harvest.match_file_patterns(files, [row]).first()["attributes"]["p20"] == "t"


def test_in_flight(spark, rows):
    files = spark.createDataFrame([("f", "a"), ("f", "b")], "processing_group_name string, file string")
    log = spark.createDataFrame(
        [Row(processing_group_name="f", identifier="a", status="RUNNING")],
    )
    assert rows(harvest.skip_in_flight(files, log)) == [("f", "b")]


def test_a_file_delivered_again_is_read_again(spark, rows, tmp_path):
    incoming = str(tmp_path / "incoming")
    feeds = control(spark, (r"sales_(\d+)", "sales", "EXTRACT_DATE", None, None, 0))
    put(f"{incoming}/a", "sales_20240101.csv", "k\n1\n")
    put(f"{incoming}/b", "sales_20240101.csv", "k\n22\n")
    texts = []

    def handler(session, date, files, batch_id):
        texts.append(sorted(open(row["path"]).read() for row in files))

    seen, run = harvester(spark, tmp_path, feeds, handler)
    assert run(archive=str(tmp_path / "done")).count() == 2
    put(f"{incoming}/a", "sales_20240101.csv", "k\n333\n")
    os.utime(f"{incoming}/a/sales_20240101.csv", (1_700_000_000,) * 2)
    assert run(archive=str(tmp_path / "done")).count() == 1
    assert run(archive=str(tmp_path / "done")).count() == 0
    assert texts == [["k\n1\n", "k\n22\n"], ["k\n333\n"]]
    # Same names meet in the archive in their own folders, versions side by side.
    assert len(os.listdir(tmp_path / "done" / "a")) == 2 and len(os.listdir(tmp_path / "done" / "b")) == 1
    # Without an archive the same version stays where it is, and is not taken again until it changes.
    put(incoming, "sales_20240102.csv", "k\n4\n")
    assert run().count() == 1 and run().count() == 0
    put(incoming, "sales_20240102.csv", "k\n4\n5\n")
    assert run().count() == 1 and run().count() == 0


def test_an_error_of_one_feed_leaves_the_others_complete(spark, rows, tmp_path):
    incoming = str(tmp_path / "incoming")
    feeds = control(spark, (r"sales_(\d+)", "sales", "EXTRACT_DATE", None, None, 0), (r"stock_(\d+)", "stock", "EXTRACT_DATE", None, None, 0))
    for name in ("sales_20240101.csv", "stock_20240101.csv", "stock_20240101_2.csv", "sales_20240102.csv"):
        put(incoming, name, "k\n1\n")
    broken = [True]

    def handler(session, date, files, batch_id):
        if broken[0] and files[0]["file"] == "stock_20240101.csv":
            raise RuntimeError("no room")

    seen, run = harvester(spark, tmp_path, feeds, handler)
    with pytest.raises(RuntimeError, match="no room"):
        run(job_per="file", parallel=3)
    log = harvest.read_log(spark, str(tmp_path / "log"))
    assert rows(log, "identifier", "status") == [("sales_20240101.csv", "COMPLETE"), ("stock_20240101.csv", "ERROR"), ("stock_20240101_2.csv", "COMPLETE")]
    broken[0] = False
    assert rows(run(), "file", "status") == [("sales_20240102.csv", "COMPLETE"), ("stock_20240101.csv", "COMPLETE")]


def test_a_dead_run_is_taken_up(spark, rows, tmp_path):
    incoming = str(tmp_path / "incoming")
    feeds = control(spark, (r"sales_(\d+)", "sales", "EXTRACT_DATE", None, None, 0))
    put(incoming, "sales_20240101.csv", "k\n1\n")

    class Killed(BaseException):
        pass

    def die(session, date, files, batch_id):
        raise Killed

    # What a driver that is gone leaves: RUNNING, with a lease.
    seen, run = harvester(spark, tmp_path, feeds)
    job = [(1, "sales", "sales_20240101.csv", f"{incoming}/sales_20240101.csv", "2024-01-01", "RUNNING")]
    harvest.write_log(spark, str(tmp_path / "log"), 1, job, lease_seconds=600)
    assert run().count() == 0
    harvest.write_log(spark, str(tmp_path / "log"), 1, job, lease_seconds=-1)
    assert rows(run(), "file", "status") == [("sales_20240101.csv", "COMPLETE")] and len(seen) == 1
    with pytest.raises(Killed):
        put(incoming, "sales_20240102.csv", "k\n1\n")
        harvester(spark, tmp_path, feeds, die)[1]()
    assert rows(run(), "file") == [("sales_20240102.csv",)]
