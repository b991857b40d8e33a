"""Run log, file matching, load order and hierarchies."""

from __future__ import annotations

from pyspark.sql import Row, functions as F

from feedwright.operators import hierarchy, params, runlog
from feedwright.operators.numbering import number_rows
from feedwright.operators.quality import datacop
from feedwright.plans.fixtures import Inputs
from feedwright.plans.quality_queries import DECLARED, FIRST_ISSUE, NAMES, PER_CELL
from feedwright.plans.registry import query
from feedwright.sources.delimited import read_delimited, write_csv
from feedwright.staging import scratch_path, stage
from feedwright.streaming import harvest


@query(
    "batch_jobs",
    """select b.batch_id, b.batch_identifier, b.status as batch_status, j.job_id, j.identifier as job_identifier,
              j.status as job_status, j.processing_time as job_processing_time
       from {batch_ctl} b left join {job_ctl} j on b.batch_id = j.batch_id""",
)
def _(i: Inputs):
    joined = runlog.batch_jobs(i.view("batch_ctl"), i.view("job_ctl"))
    return joined.select(
        "batch_id", "batch_identifier", "batch_status", "job_id", "job_identifier", "job_status", "job_processing_time"
    )


@query(
    "batch_jobs_recent",
    """select b.batch_id, count(j.job_id) as n_jobs from {batch_ctl} b left join {job_ctl} j on b.batch_id = j.batch_id
       where b.start_ts >= timestamp '2024-01-08 00:00:00' - interval 7 days group by b.batch_id""",
)
def _(i: Inputs):
    joined = runlog.batch_jobs(
        i.view("batch_ctl"),
        i.view("job_ctl"),
        days=7,
        now=F.lit("2024-01-08 00:00:00").cast("timestamp_ntz"),
        limit=None,
    )
    return joined.groupBy("batch_id").agg(F.count("job_id").alias("n_jobs"))


@query(
    "batch_status",
    """select b.batch_id, count(*) filter (where j.status <> 'COMPLETE') as error_number,
              case when count(*) filter (where j.status <> 'COMPLETE') > 0 then 'COMPLETE_WITH_ERROR' else 'COMPLETE' end
                  as status
       from {batch_ctl} b left join {job_ctl} j on b.batch_id = j.batch_id group by b.batch_id""",
)
def _(i: Inputs):
    return runlog.batch_status(i.view("batch_ctl"), i.view("job_ctl"))


@query("max_runtime", "select batch_identifier, max(processing_time) as max_runtime from {batch_ctl} b group by all")
def _(i: Inputs):
    return runlog.max_runtime(i.view("batch_ctl"))


@query(
    "runtime_progress",
    """select batch_id, cast(b.processing_time / coalesce(nullif(m, 0), 1) * 100 as decimal(18,3)) as progress
       from {batch_ctl} b join (select batch_identifier, max(processing_time) as m from {batch_ctl} x group by all) l
            on l.batch_identifier = b.batch_identifier""",
)
def _(i: Inputs):
    batches = i.view("batch_ctl")
    running = batches.select("batch_id", "batch_identifier", F.col("processing_time").alias("seconds"))
    return runlog.runtime_progress(running, batches).select("batch_id", "progress")


@query(
    "group_steps",
    """select event_type as processing_group_name, 0 as disable_flag, count(event_id) as template_steps
       from events group by event_type""",
)
def _(i: Inputs):
    config = i.table("events").select(
        F.col("event_type").alias("processing_group_name"), F.col("event_id").alias("sequence_order")
    )
    groups = config.select("processing_group_name").distinct().withColumn("disable_flag", F.lit(0))
    return runlog.group_steps(config, groups)


@query(
    "job_steps",
    """select job_id, sequence_order, load_execution_id, template_name, rows_affected,
              coalesce(target_db_name, '') || '.' || target_schema_name || '.' || target_table_name as target
       from {load_execution} l""",
)
def _(i: Inputs):
    return runlog.job_steps(i.view("load_execution")).select(
        "job_id", "sequence_order", "load_execution_id", "template_name", "rows_affected", "target"
    )


@query("last_value", "select max(job_id) as last_job from {job_ctl} j")
def _(i: Inputs):
    return runlog.last_value(i.view("job_ctl"), "job_id", "last_job")


@query("log_types", "select distinct doc_id as load_execution_id, source as log_type from documents where source not in ('log', 'error')")
def _(i: Inputs):
    parts = i.table("documents").select(F.col("doc_id").alias("load_execution_id"), F.col("source").alias("log_type"))
    return runlog.log_types(parts)


@query(
    "split_text_parts",
    """select doc_id, cast(part_sequence as integer) as part_sequence,
              substring(text, (part_sequence - 1) * 500 + 1, 500) as part_text
       from (select doc_id, text, unnest(range(1, cast(floor(length(text) / 500) as bigint) + 2)) as part_sequence
             from documents) d""",
)
def _(i: Inputs):
    return runlog.split_text_parts(i.table("documents").select("doc_id", "text"), "text", 500)


@query("reassemble_text", "select doc_id, text from documents")
def _(i: Inputs):
    parts = runlog.split_text_parts(i.table("documents").select("doc_id", "text"), "text", 500)
    return runlog.reassemble_text(parts, ["doc_id"])


@query(
    "step_tree",
    """with recursive cfg as materialized (select * from {config} c),
       a as (select sequence_order, parent_sequence_order, 1 as lvl from cfg
             union all
             select d.sequence_order, d.parent_sequence_order, a.lvl + 1
             from cfg d join a on a.sequence_order = d.parent_sequence_order)
       select c.sequence_order, c.parent_sequence_order, c.template_name, cast(max(a.lvl) as integer) as recursion_level
       from cfg c join a on a.sequence_order = c.sequence_order where c.disable_flag = 0 group by all""",
)
def _(i: Inputs):
    return hierarchy.step_tree(i.view("config"), "nightly")


@query(
    "step_tree_below",
    """with recursive cfg as materialized (select * from {config} c),
       a as (select sequence_order, 1 as lvl from cfg where parent_sequence_order = 3
             union all
             select d.sequence_order, a.lvl + 1 from cfg d join a on a.sequence_order = d.parent_sequence_order)
       select c.sequence_order, c.parent_sequence_order, c.template_name, cast(max(a.lvl) as integer) as recursion_level
       from cfg c join a on a.sequence_order = c.sequence_order where c.disable_flag = 0 group by all""",
)
def _(i: Inputs):
    return hierarchy.step_tree(i.view("config"), "nightly", root=3)


@query(
    "root_blocker",
    """with recursive w as materialized (select distinct waiting, blocking from {lock_waits} l),
       walk as (select waiting, blocking, blocking as root, [blocking] as path from w
                union all
                select k.waiting, k.blocking, w.blocking, list_append(k.path, w.blocking)
                from walk k join w on w.waiting = k.root where not list_contains(k.path, w.blocking)),
       ends as (select waiting, blocking, root, min(len(path)) as depth from walk
                where root not in (select waiting from w) group by all)
       select w.waiting, w.blocking, e.root, cast(e.depth as integer) as depth
       from w left join ends e on e.waiting = w.waiting and e.blocking = w.blocking""",
)
def _(i: Inputs):
    """Every 50th process waits for itself, a cycle that has no root; every seventh waits for a second blocker."""
    return hierarchy.root_blocker(i.view("lock_waits"))


CONTROL = [
    Row(
        file_regex=r"^orders_(\d{8})_(\d+)\.csv$",
        processing_group_name="orders_compact",
        perform_load_order_check=1,
        pos_1="EXTRACT_DATE",
        pos_2="SEQUENCE",
        record_length=None,
    ),
    Row(
        file_regex=r"^orders-(\d{4}-\d{2}-\d{2})-",
        processing_group_name="orders_dashed",
        perform_load_order_check=0,
        pos_1="EXTRACT_DATE",
        pos_2=None,
        record_length=12,
    ),
    Row(
        file_regex=r"^orders-\d{4}-(\d{2})",
        processing_group_name="orders_other",
        perform_load_order_check=0,
        pos_1="MONTH",
        pos_2=None,
        record_length=None,
    ),
]
MATCHED = r"""
    select file,
           case when regexp_matches(file, '^orders_(\d{8})_(\d+)\.csv$', 'i') then 'orders_compact'
                when regexp_matches(file, '^orders-(\d{4}-\d{2}-\d{2})-', 'i') and first_line_length = 12
                then 'orders_dashed'
                when regexp_matches(file, '^orders-\d{4}-(\d{2})', 'i') then 'orders_other' end as feed
    from {feed_files} f"""


@query("match_file_patterns", f"select file, feed as processing_group_name from ({MATCHED}) m where feed is not null")
def _(i: Inputs):
    return harvest.match_file_patterns(i.view("feed_files"), CONTROL).select("file", "processing_group_name")


@query(
    "match_file_positions",
    r"""select file, regexp_extract(file, '^orders_(\d{8})_(\d+)\.csv$', 1, 'i') as extract_date,
               regexp_extract(file, '^orders_(\d{8})_(\d+)\.csv$', 2, 'i') as sequence
        from {feed_files} f where regexp_matches(file, '^orders_(\d{8})_(\d+)\.csv$', 'i')""",
)
def _(i: Inputs):
    matched = harvest.match_file_patterns(i.view("feed_files"), CONTROL[:1])
    return matched.select(
        "file", F.col("attributes")["EXTRACT_DATE"].alias("extract_date"), F.col("attributes")["SEQUENCE"].alias("sequence")
    )


@query(
    "order_by_extract_date",
    f"""select file, case feed when 'orders_compact'
                     then concat(substring(file, 8, 4), '-', substring(file, 12, 2), '-', substring(file, 14, 2))
                     when 'orders_dashed' then substring(file, 8, 10) else '2024-01-15 00:00:00' end as extract_date
        from ({MATCHED}) m where feed is not null""",
)
def _(i: Inputs):
    matched = harvest.match_file_patterns(i.view("feed_files"), CONTROL)
    return harvest.order_by_extract_date(matched, now=F.lit("2024-01-15 00:00:00")).select("file", "extract_date")


# Runs of a feed: the log holds days of even events, the files are all events moved on by up to three days.
LOAD_LOG = """select job_id, processing_group_name, status, cast(extract_ts as date) as extract_ts from {job_ctl}"""
LOAD_FILES = """select event_id as file_no, concat('feed_', cast(user_id % 25 as string)) as processing_group_name,
                       date_add(cast(ts as date), cast(event_id % 9 as int)) as extract_ts from {events}"""


@query(
    "load_gap",
    """with log as materialized (select job_id, processing_group_name, status, cast(extract_ts as date) as extract_ts
                                 from {job_ctl} j),
            files as (select event_id as file_no, concat('feed_', cast(user_id % 25 as varchar)) as processing_group_name,
                             cast(ts as date) + cast(event_id % 9 as integer) as extract_ts from events),
            last as (select processing_group_name, arg_max(extract_ts, job_id) as last_success from log
                     where status = 'COMPLETE' group by all)
       select f.file_no, f.processing_group_name,
              case when l.last_success is null then 'FIRST' when l.last_success > f.extract_ts then 'ERROR_OLDER'
                   when l.last_success + 1 = f.extract_ts then 'OK'
                   when exists (select 1 from log e where e.processing_group_name = f.processing_group_name
                                  and e.status <> 'COMPLETE' and e.extract_ts > l.last_success
                                  and e.extract_ts < f.extract_ts) then 'ERROR_GAP'
                   else 'WARNING_GAP' end as verdict
       from files f left join last l on l.processing_group_name = f.processing_group_name""",
)
def _(i: Inputs):
    judged = harvest.load_gap(i.sql(LOAD_LOG), i.sql(LOAD_FILES))
    return judged.select("file_no", "processing_group_name", "verdict")


@query(
    "skip_in_flight",
    """select f.file, f.processing_group_name
       from (select concat('file_', cast(event_id as varchar)) as file,
                    concat('feed_', cast(user_id % 20 as varchar)) as processing_group_name from events) f
       where not exists (select 1 from {job_ctl} j where j.identifier = f.file
                         and j.processing_group_name = f.processing_group_name and j.status in ('READY', 'RUNNING'))""",
)
def _(i: Inputs):
    files = i.sql(
        "select concat('file_', event_id) as file, concat('feed_', user_id % 20) as processing_group_name from {events}"
    )
    return harvest.skip_in_flight(files, i.view("job_ctl")).select("file", "processing_group_name")


@query(
    "query_params",
    "select o_orderkey, o_custkey from orders where o_custkey > (select cast(avg(o_custkey) as integer) from orders)",
)
def _(i: Inputs):
    """One row of a query feeds the arguments of the next."""
    found = params.query_params(i.sql("select cast(round(avg(o_custkey)) as int) as `mean key` from {orders}"))
    return i.spark.sql(
        "select o_orderkey, o_custkey from {orders} where o_custkey > :mean_key", args=found, orders=i.table("orders")
    )


@query(
    "for_each_row",
    """select r_name as region, count(*) as n_customers
       from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey group by all""",
)
def _(i: Inputs):
    """One branch per region of the control table."""
    customers = i.table("customer").join(i.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))

    def one(row: Row):
        here = customers.where(F.col("n_regionkey") == row["r_regionkey"])
        return here.groupBy().agg(F.count("*").alias("n_customers")).select(F.lit(row["r_name"]).alias("region"), "n_customers")

    return params.for_each_row(i.table("region"), one)


@query("affected_rows", "select count(*) as rows_affected from orders where o_orderstatus = 'F'")
def _(i: Inputs):
    """Rows counted while they are written, joined to nothing and read once."""
    counted, seen = runlog.affected_rows(i.table("orders").where("o_orderstatus = 'F'"))
    written = stage(counted)
    return written.limit(1).select(F.lit(seen.get["rows_affected"]).alias("rows_affected"))


@query(
    "step_audit",
    """select 7 as job_id, 10 as sequence_order, 'COMPLETE' as execution_sts, count(*) as rows_affected from orders""",
)
def _(i: Inputs):
    log = scratch_path(i.spark, "log")
    with runlog.step_audit(i.spark, log, 7, "nightly", 10, "SQL", ("db", "core", "orders")) as facts:
        counted, seen = runlog.affected_rows(i.table("orders"))
        stage(counted)
        facts["rows_affected"] = seen.get["rows_affected"]
    return i.spark.read.parquet(log).select(
        F.col("job_id").cast("int").alias("job_id"), "sequence_order", "execution_sts", "rows_affected"
    )


@query(
    "check_load_order",
    """with n as (select concat('feed_', cast(o_custkey % 25 as varchar)) as feed, count(*) as days from orders group by all)
       select feed as processing_group_name,
              case cast(substr(feed, 6) as integer) % 4 when 0 then 'OK' when 1 then 'ERROR_OLDER' when 2 then 'ERROR_GAP'
                   else 'WARNING_GAP' end as verdict,
              cast(substr(feed, 6) as integer) % 4 in (1, 2) as stopped
       from n""",
)
def _(i: Inputs):
    """A log with one run per order; a new file per feed, on the next day, before, after a failed run or after a gap.

    The check is on for every feed; it is made for each kind of file, and those of an error kind stop there.
    """
    orders = i.sql("select concat('feed_', o_custkey % 25) as processing_group_name, o_custkey % 25 as k, o_orderkey from {orders}")
    # Numbered over all feeds at once, as a window per feed has no more tasks than feeds; the days are long, as seconds pass an int.
    numbered = number_rows(orders, ["k", "o_orderkey"], "n")
    starts = numbered.groupBy(F.col("k").alias("feed_k")).agg(F.min("n").alias("start"))
    runs = numbered.join(F.broadcast(starts), F.col("k").eqNullSafe(F.col("feed_k"))).withColumn("d", F.col("n") - F.col("start") + 1)
    log = stage(
        i.spark.sql(
            """select processing_group_name, k, d as job_id, timestamp_seconds(d * 86400) as extract_ts, 'COMPLETE' as status from {runs}
               union all
               select processing_group_name, k, max(d) + 1, timestamp_seconds((max(d) + 2) * 86400), 'ERROR' from {runs} where k % 4 = 2 group by 1, 2""",
            runs=runs,
        ),
        "log",
    )
    last = log.where("status = 'COMPLETE'").groupBy("processing_group_name", "k").agg(F.max("extract_ts").alias("last"))
    days = F.element_at(F.array(*map(F.lit, (1, -1, 4, 4))), (F.col("k") % 4 + 1).cast("int"))
    files = stage(
        last.select(
            "processing_group_name", F.concat(F.lit("file of "), "processing_group_name").alias("file"), "k",
            F.timestamp_seconds(F.unix_timestamp("last") + days * 86400).alias("extract_ts"), F.lit(1).alias("perform_load_order_check"),
        )
    )
    parts = []
    for kind in range(4):
        mine = files.where(F.col("k") % 4 == kind)
        try:
            judged, stopped = harvest.check_load_order(log, mine), False
        except ValueError:
            judged, stopped = harvest.load_gap(log, mine), True
        # Judged one kind after the other, or a task may hold the joins of all four.
        parts.append(stage(judged.select("processing_group_name", "verdict", F.lit(stopped).alias("stopped")), "judged"))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(
    "route_by_record_length",
    """select o_orderstatus, cast(y as varchar) as y, cast(length(arg_min(o_orderpriority, o_orderkey)) as integer) as first_line_length
       from (select o_orderstatus, year(cast(o_orderdate as date)) as y, o_orderkey, o_orderpriority from orders) o group by all""",
)
def _(i: Inputs):
    """A file per order status and year, whose lines differ in length; of each only the head is read."""
    path = scratch_path(i.spark, "fixed")
    lines = i.table("orders").select("o_orderstatus", F.year(F.col("o_orderdate").cast("date")).alias("y"), "o_orderkey", F.col("o_orderpriority").alias("value"))
    ordered = lines.repartition("o_orderstatus", "y").sortWithinPartitions("o_orderstatus", "y", "o_orderkey")
    ordered.drop("o_orderkey").write.partitionBy("o_orderstatus", "y").text(path)
    found = harvest.route_by_record_length(i.spark, path)
    return found.select(
        F.regexp_extract("path", "o_orderstatus=([A-Z])", 1).alias("o_orderstatus"),
        F.regexp_extract("path", "y=([0-9]+)", 1).alias("y"),
        "first_line_length",
    )


@query(
    "harvest_stream",
    """select strftime(d, '%Y-%m-%d') as extract_date, row_number() over (order by d) as nth, n_lines
       from (select date_trunc('year', cast(o_orderdate as date)) as d, count(*) as n_lines from orders group by all) f""",
)
def _(i: Inputs):
    """A file per year, discovered a few at a time in any order and handled by date over all; a dry run changes nothing."""
    written, incoming, checkpoint = (scratch_path(i.spark, name) for name in ("written", "incoming", "stream"))
    year = F.date_format(F.trunc(F.col("o_orderdate").cast("date"), "year"), "yyyyMMdd").alias("year")
    lines = i.table("orders").select(year, F.col("o_orderkey").cast("string").alias("value"))
    lines.repartition("year").write.partitionBy("year").text(written)
    hadoop = i.spark.sparkContext._jvm.org.apache.hadoop.fs
    system = hadoop.Path(incoming).getFileSystem(i.spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(hadoop.Path(incoming))
    for row in i.spark.read.format("binaryFile").load(written).select("path", "year").collect():
        system.rename(hadoop.Path(row["path"]), hadoop.Path(f"{incoming}/orders_{row['year']}.csv"))
    feed = Row(file_regex=r"^orders_(\d+)", processing_group_name="orders", pos_1="EXTRACT_DATE", perform_load_order_check=0)
    feeds = i.spark.createDataFrame([feed])
    counts = []

    def handler(spark, date, files, batch_id):
        counts.append((date, len(counts) + 1, spark.read.text([row["path"] for row in files]).count()))

    options = {"spark": i.spark, "incoming": incoming, "control": feeds, "checkpoint": checkpoint, "handler": handler}
    harvest.harvest_stream(**options, dry_run=True)
    harvest.harvest_stream(**options, max_files=2)
    return i.spark.createDataFrame(counts, "extract_date string, nth bigint, n_lines bigint")


@query(
    "harvest_versions",
    """select feed, extract_date, sum(n_lines) as n_lines, count(*) as n_jobs, sum(case when failed then 1 else 0 end) as n_errors from (
           select o_orderstatus as feed, strftime(date_trunc('year', cast(o_orderdate as date)), '%Y-%m-%d') as extract_date,
                  count(*) as n_lines, false as failed from orders group by all
           union all
           select 'F', strftime(date_trunc('year', cast(o_orderdate as date)), '%Y-%m-%d'), count(*), false from orders
           where o_orderstatus = 'O' and year(cast(o_orderdate as date)) = 1996 group by all
           union all
           select 'P', '1995-01-01', 0, true) j
       group by all""",
)
def _(i: Inputs):
    """A file per order status and year, a feed per status. Feed P fails once in 1995, which leaves the others of that
    date complete; then a file of feed F is delivered again under its name with other rows, and only it is read again."""
    written, incoming, checkpoint = (scratch_path(i.spark, name) for name in ("written", "incoming", "stream"))
    year = F.date_format(F.trunc(F.col("o_orderdate").cast("date"), "year"), "yyyyMMdd").alias("year")
    lines = i.table("orders").select("o_orderstatus", year, F.col("o_orderkey").cast("string").alias("value"))
    lines.repartition("o_orderstatus", "year").write.partitionBy("o_orderstatus", "year").text(written)
    hadoop = i.spark.sparkContext._jvm.org.apache.hadoop.fs
    system = hadoop.Path(incoming).getFileSystem(i.spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(hadoop.Path(incoming))
    paths = {(row["o_orderstatus"], str(row["year"])): row["path"] for row in i.spark.read.format("binaryFile").load(written).select("path", "o_orderstatus", "year").collect()}

    def deliver(status: str, when: str, name: str) -> None:
        target = hadoop.Path(f"{incoming}/{name}_{when}.csv")
        system.delete(target, False)
        hadoop.FileUtil.copy(system, hadoop.Path(paths[status, when]), system, target, False, i.spark.sparkContext._jsc.hadoopConfiguration())

    for status, when in paths:
        deliver(status, when, status)
    feeds = i.spark.createDataFrame([Row(file_regex=rf"^{name}_(\d+)", processing_group_name=name, pos_1="EXTRACT_DATE", perform_load_order_check=0) for name in "FOP"])
    broken, counts = [True], []

    def handler(spark, date, files, batch_id):
        feed = files[0]["processing_group_name"]
        if broken[0] and (feed, date) == ("P", "1995-01-01"):
            broken[0] = False
            counts.append((feed, date, 0, True))
            raise RuntimeError("feed P fails once")
        counts.append((feed, date, spark.read.text([row["path"] for row in files]).count(), False))

    options = {"spark": i.spark, "incoming": incoming, "control": feeds, "checkpoint": checkpoint, "handler": handler, "parallel": 3}
    try:
        harvest.harvest_stream(**options)
    except RuntimeError:
        harvest.harvest_stream(**options)
    deliver("O", "19960101", "F")
    harvest.harvest_stream(**options)
    done = i.spark.createDataFrame(counts, "feed string, extract_date string, n_lines bigint, failed boolean")
    return done.groupBy("feed", "extract_date").agg(F.sum("n_lines").alias("n_lines"), F.count("*").alias("n_jobs"), F.count_if("failed").alias("n_errors"))


@query("harvest_datacop", "select " + NAMES + " from {orders_text} t where " + FIRST_ISSUE + " is null")
def _(i: Inputs):
    """Feed files picked up by the stream, validated, good rows read back from the sink."""
    incoming, out = scratch_path(i.spark, "incoming"), scratch_path(i.spark, "harvested")
    write_csv(i.view("orders_text"), incoming, headers=False)
    feed = Row(file_regex=r"^part-(\d+)-", processing_group_name="orders", pos_1="SEQUENCE")
    handler = harvest.harvest_datacop({"orders": DECLARED}, out, header=False, null_value="\\N")
    harvest.harvest_stream(i.spark, incoming, i.spark.createDataFrame([feed]), scratch_path(i.spark, "stream"), handler)
    return read_delimited(i.spark, f"{out}/good/*/*/*", columns=NAMES.split(", "), null_value="\\N")


@query(
    "enforce_max_issues",
    "select column_name, count(*) as issue_count from (" + PER_CELL + ") c where issue_type is not null group by all",
)
def _(i: Inputs):
    """The summary of a feed whose issues stay below the limit."""
    result = datacop(i.view("orders_text"), DECLARED, max_issues=2**31)
    return result.summary.groupBy("column_name").agg(F.sum("issue_count").alias("issue_count"))
