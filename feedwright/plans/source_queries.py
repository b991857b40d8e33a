"""Readers, writers and loads: rows are rendered to files, read back and compared with the original columns."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from feedwright.operators import scd
from feedwright.operators.maintenance import partitions_for
from feedwright.operators.onboarding import onboard_feed
from feedwright.plans.dimension_queries import APPLIED
from feedwright.plans.fixtures import EXTRACT_DATE, Inputs
from feedwright.plans.registry import query
from feedwright.sources import catalog, delimited, load, logs, objects
from feedwright.staging import scratch_path, stage

DOCUMENTS = "select cast(doc_id as varchar) as doc_id, lang, source, text from documents"
NAMES = ["doc_id", "lang", "source", "text"]


def _documents(i: Inputs) -> DataFrame:
    """Whole texts, line breaks and quotes included."""
    return i.table("documents").select(F.col("doc_id").cast("string"), "lang", "source", "text")


def _orders(i: Inputs) -> DataFrame:
    return i.view("orders_text")


ORDER_NAMES = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDERS = "select " + ", ".join(ORDER_NAMES) + " from {orders_text} t"


@query("write_csv", DOCUMENTS)
def _(i: Inputs):
    """Texts with quotes and line breaks survive a quoted file."""
    path = scratch_path(i.spark, "csv")
    delimited.write_csv(_documents(i), path, escape='"', always_quote=True)
    return delimited.read_delimited(
        i.spark, path, escape='"', null_value="\\N", columns=NAMES, multiline=True
    )


@query("read_delimited", ORDERS)
def _(i: Inputs):
    path = scratch_path(i.spark, "tsv")
    delimited.write_csv(_orders(i), path, sep="\\t", upper_headers=False)
    return delimited.read_delimited(i.spark, path, sep="\\t", null_value="\\N")


@query("export_table", ORDERS)
def _(i: Inputs):
    path = scratch_path(i.spark, "export")
    delimited.export_table(_orders(i), path, "bcp", sep="\\001")
    return delimited.read_delimited(
        i.spark, path, sep="\\001", header=False, columns=ORDER_NAMES, null_value="\\N"
    )


@query("export_partitioned", "select count(*) as n_rows, true as several_parts from orders")
def _(i: Inputs):
    base = scratch_path(i.spark, "parts")
    parts = delimited.export_partitioned(
        i.table("orders").select("o_orderkey"), base, 7, max_records_per_file=400
    )
    rows = i.spark.read.option("header", True).csv(f"{base}/job-7.export")
    listed = parts.select((F.count("*") > 1).alias("several_parts"))
    return rows.agg(F.count("*").alias("n_rows")).withColumn("several_parts", listed.scalar())


@query(
    "list_objects",
    """select concat('type=', event_type) as folder, count(*) as n_files, sum(n) as n_lines
       from (select event_type, event_id % 3 as part, count(*) as n from events group by all) f group by all""",
)
def _(i: Inputs):
    """Files in three folders to a type, found below a prefix; what lies beside it is not listed."""
    base = scratch_path(i.spark, "objects")
    lines = i.table("events").select("event_type", (F.col("event_id") % 3).alias("part"), F.lit("x").alias("value"))
    # A folder's lines lie in one file, or in more when they are many: writing sorts the rows of a task by folder.
    dealt = lines.repartition(partitions_for(lines, 1)).withColumnRenamed("event_type", "type")
    for folder in ("day=1", "night=1"):
        dealt.write.partitionBy("type", "part").text(f"{base}/{folder}")
    listed = objects.list_objects(i.spark, base, prefix="day=1/", pattern="part-*")
    folder = F.regexp_extract("path", r"(type=[^/]*)/part=", 1).alias("folder")
    # Every line of a file is two bytes.
    return listed.groupBy(folder).agg(F.countDistinct("path").alias("n_files"), (F.sum("size") / 2).cast("long").alias("n_lines"))


@query("write_ndjson", "select conv_id, turn, nullif(role, 'user') as role, text from conversations")
def _(i: Inputs):
    path = scratch_path(i.spark, "ndjson")
    rows = i.table("conversations").withColumn("role", F.nullif("role", F.lit("user")))
    delimited.write_ndjson(rows, path)
    return i.spark.read.schema(rows.schema).json(path)


@query(
    "ndjson_null_keys",
    """select count(*) as n_lines, count(*) as n_with_null_key from conversations""",
)
def _(i: Inputs):
    path = scratch_path(i.spark, "ndjson")
    rows = i.table("conversations").select("conv_id", F.lit(None).cast("string").alias("nothing"))
    delimited.write_ndjson(rows, path)
    return i.spark.read.text(path).agg(
        F.count("*").alias("n_lines"), F.count_if(F.contains("value", F.lit('"nothing":null'))).alias("n_with_null_key")
    )


@query(
    "transcode_csv",
    """select cast(conv_id as varchar) as conv_id, role, replace(text, chr(10), chr(13)) as text from conversations""",
)
def _(i: Inputs):
    source, target = scratch_path(i.spark, "in"), scratch_path(i.spark, "out")
    rows = i.table("conversations").select(F.col("conv_id").cast("string"), "role", "text")
    delimited.write_csv(rows, source, escape='"', always_quote=True, upper_headers=False)
    delimited.transcode_csv(
        i.spark,
        source,
        target,
        {"escape": '"', "multiline": True, "columns": rows.columns},
        {"sep": "|", "escape": "\\", "always_quote": True},
        mangle_eols=True,
    )
    return delimited.read_delimited(
        i.spark, target, sep="|", columns=rows.columns, multiline=True, eol=None
    )


@query(
    "skip_leading_rows",
    "select cast(o_orderkey as varchar) as o_orderkey, o_orderpriority from orders",
)
def _(i: Inputs):
    """Three leading lines in every file of the folder are dropped."""
    path = scratch_path(i.spark, "garbage")
    body = i.table("orders").select(F.concat_ws(",", "o_orderkey", "o_orderpriority").alias("value"))
    lines = body.repartition("value")
    lines.mapInPandas(_with_preamble, "value string").write.text(path)
    return delimited.skip_leading_rows(i.spark, path, 3, ["o_orderkey", "o_orderpriority"])


def _with_preamble(batches):
    """Put three lines before the rows of a part, also when it has none."""
    import pandas as pd

    yield pd.DataFrame({"value": ["report of orders", "made for a test", "o_orderkey,o_orderpriority"]})
    yield from batches


@query("number_lines", "select count(*) as n_lines, true as dense from lineitem")
def _(i: Inputs):
    """Lines of every file are numbered 1 … n whatever its splits are."""
    path = scratch_path(i.spark, "lines")
    i.table("lineitem").select(F.col("l_orderkey").cast("string").alias("value")).write.text(path)
    numbered = delimited.number_lines(i.spark, path)
    repeated = numbered.groupBy("file", "line_no").agg(F.count("*").alias("n"))
    files = repeated.groupBy("file").agg(F.sum("n").alias("n"), F.max("line_no").alias("top"), F.max("n").alias("most"))
    dense = (F.col("n") == F.col("top")) & (F.col("most") == 1)
    return files.agg(F.sum("n").alias("n_lines"), F.every(dense).alias("dense"))


@query("read_csv_with_headings_file", ORDERS)
def _(i: Inputs):
    base = scratch_path(i.spark, "headed")
    delimited.write_csv(_orders(i), f"{base}/orders.csv", headers=False)
    headings = i.spark.createDataFrame([(",".join(ORDER_NAMES),)], "value string")
    headings.coalesce(1).write.text(f"{base}/orders.csv.headers")
    return delimited.read_csv_with_headings_file(i.spark, f"{base}/orders.csv", null_value="\\N")


@query("schema_from_headings", "select cast(o_orderkey as bigint) as o_orderkey, o_orderstatus, cast(o_orderdate as date) as o_orderdate from orders")
def _(i: Inputs):
    from feedwright.functions.types import schema_from_headings

    path = scratch_path(i.spark, "typed")
    rows = i.table("orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date"))
    delimited.write_csv(rows, path, headers=False)
    schema = schema_from_headings(rows.columns, {"o_orderkey": "INTEGER", "o_orderdate": "DATE"})
    return i.spark.read.schema(schema).csv(path)


@query(
    "table_from_string",
    "select cast(o_orderkey as varchar) as o_orderkey, o_orderpriority, o_orderstatus from orders",
)
def _(i: Inputs):
    """One literal text per order, a heading line and a value line."""
    line = F.concat_ws(" , ", F.col("o_orderkey").cast("string"), "o_orderpriority", "o_orderstatus")
    texts = i.table("orders").select(F.concat(F.lit("order key,priority,status\n"), line).alias("text"))
    return delimited.table_from_text_column(texts, "text", ["o_orderkey", "o_orderpriority", "o_orderstatus"])


LOG_REGEX = r"^(\d+) \[(\w+)\] user=(\d+) v=(-?[\d.]+)$"


@query(
    "parse_log_lines",
    """select event_id as line_no, cast(event_id as varchar) as event_id, event_type, cast(user_id as varchar) as user_id,
              cast(cast(value as decimal(18,2)) as varchar) as value
       from events where event_id % 60 <> 0 and event_id % 50 <> 0""",
)
def _(i: Inputs):
    return logs.parse_log_lines(i.view("log_lines"), LOG_REGEX, ["event_id", "event_type", "user_id", "value"])[0]


@query(
    "parse_log_lines_counts",
    """select count(*) as lines_read, count(*) filter (where event_id % 60 <> 0 and event_id % 50 <> 0) as lines_parsed,
              count(*) filter (where event_id % 60 = 0) as error_state_lines,
              count(*) filter (where event_id % 50 = 0 and event_id % 60 <> 0) as bad_lines from events""",
)
def _(i: Inputs):
    return logs.parse_log_lines(i.view("log_lines"), LOG_REGEX, error_state_regex="^#")[2]


@query(
    "parse_load_error_log",
    """select cast(11 as bigint) as job_id, event_id as bad_no, event_id * 3 as input_row, event_id % 97 as byte_offset,
              event_id % 9 as field_no, 'VARCHAR(5)' as declaration, 'text field too long' as diagnostic,
              event_type as text_consumed, substring(event_type, 1, 1) as last_char_examined,
              concat(cast(event_id as varchar), '|', event_type, '|', cast(user_id as varchar)) as bad_record,
              'warehouse' as target_db, 'events' as target_table
       from events where event_id % 4 <> 0""",
)
def _(i: Inputs):
    return logs.parse_load_error_log(i.view("reject_log"), i.view("reject_records"), 11, "warehouse", "events")


TYPED = "o_orderkey bigint, o_custkey int, o_orderstatus string, o_totalprice decimal(18,2), o_orderdate date, o_orderpriority string"


@query(
    "load_file",
    """select count(*) filter (where not bad) as rows_loaded, count(*) filter (where bad) as rows_bad
       from (select (o_custkey is not null and try_cast(o_custkey as integer) is null)
                 or try_cast(o_totalprice as decimal(18,2)) is null
                 or try_cast(o_orderdate as date) is null as bad from {orders_text} t) b""",
)
def _(i: Inputs):
    path = scratch_path(i.spark, "load")
    delimited.write_csv(_orders(i), path)
    flagged = load.flag_load_rows(
        i.spark, path, T.StructType.fromDDL(TYPED), header=True, null_value="\\N", date_style="YMD"
    )
    return flagged.agg(
        F.count_if(~F.col("_bad")).alias("rows_loaded"), F.count_if(F.col("_bad")).alias("rows_bad")
    )


@query(
    "load_file_json",
    "select count(*) filter (where event_id % 10 <> 0) as rows_loaded, count(*) filter (where event_id % 10 = 0) as rows_bad from events",
)
def _(i: Inputs):
    """NDJSON in which every tenth line has a key the table lacks."""
    path = scratch_path(i.spark, "load")
    known = F.to_json(F.struct("event_id", "event_type"))
    unknown = F.to_json(F.struct("event_id", "event_type", F.lit(1).alias("surplus")))
    i.table("events").select(
        F.when(F.col("event_id") % 10 == 0, unknown).otherwise(known).alias("value")
    ).write.text(path)
    flagged = load.flag_load_rows(
        i.spark, path, T.StructType.fromDDL("event_id bigint, event_type string"), fmt="json"
    )
    return flagged.agg(
        F.count_if(~F.col("_bad")).alias("rows_loaded"), F.count_if(F.col("_bad")).alias("rows_bad")
    )


@query("archive_temp", "select c_custkey, c_name from customer")
def _(i: Inputs):
    base = scratch_path(i.spark, "archive")
    i.table("customer").select("c_custkey", "c_name").createOrReplaceTempView("feedwright_archived")
    catalog.archive_temp(i.spark, base, 7, ["feedwright_archived"])
    i.spark.catalog.dropTempView("feedwright_archived")
    return i.spark.read.parquet(f"{base}/job_id=7/feedwright_archived")


@query(
    "describe_table",
    """select column_name, cast(rank as integer) as position, (select count(*) from orders) as n_rows
       from (select unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate',
                            'o_orderpriority']) as column_name, unnest([0, 1, 2, 3, 4, 5]) as rank) d""",
)
def _(i: Inputs):
    """Columns of a table beside its row count."""
    orders = i.table("orders")
    described = catalog.describe_table(orders).select("column_name", "position")
    return described.withColumn("n_rows", orders.select(F.count("*")).scalar())


@contextmanager
def _scratch_schema(spark: SparkSession):
    """A schema of its own for queries that publish tables; dropped afterwards."""
    name = f"feedwright_{uuid.uuid4().hex[:12]}"
    spark.sql(f"create schema {name} location '{scratch_path(spark, 'schema')}'")
    try:
        yield name
    finally:
        spark.sql(f"drop schema {name} cascade")


@query(
    "publish",
    """select o_orderkey, o_custkey from orders where o_orderstatus = 'F'
       union all select c_custkey + 1000000000, c_custkey from customer""",
)
def _(i: Inputs):
    """A table replaced by a query over itself, together with a second one."""
    with _scratch_schema(i.spark) as schema:
        orders = f"{schema}.orders"
        i.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus").write.saveAsTable(orders)
        done = i.spark.table(orders).where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
        others = i.table("customer").select(
            (F.col("c_custkey") + 1000000000).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey")
        )
        tables = catalog.publish(i.spark, {orders: done, f"{schema}.others": others})
        return stage(tables[orders].unionByName(tables[f"{schema}.others"]))


# Dates with slashes, some of a month 13; clock times with AM and PM, some at minute 99; a lone minus for a number.
ONBOARDED = """
    select cast(o_orderkey as string) as k,
           case when o_orderkey % 7 = 0 then '13/28/2020'
                else concat(cast(1 + o_orderkey % 12 as string), '/', cast(1 + o_orderkey % 28 as string), '/2020') end as d,
           case when o_orderkey % 5 = 0 then '1/2/2020 10:99:30 PM' else concat('1/2/2020 ', cast(1 + o_orderkey % 12 as string),
                ':02:03 PM') end as t,
           case when o_orderkey % 11 = 0 then '-' else cast(o_custkey as string) end as c
    from {orders}"""
REFUSED = "k % 7 = 0 or k % 5 = 0 or k % 11 = 0"


@query(
    "onboard_feed",
    f"""with f as (select cast(k as bigint) as k, d, t, c from ({ONBOARDED}) o)
        select 'good' as kind, cast(k as varchar) as k, strftime(date '2020-01-01' + interval (k % 12) month
                   + interval (k % 28) day, '%Y-%m-%d') as d,
               strftime(timestamp '2020-01-02 12:02:03' + interval ((k + 1) % 12) hour, '%Y-%m-%d %H:%M:%S') as t, c,
               0 as n_issues
        from f where not ({REFUSED})
        union all
        select 'bad', cast(k as varchar), d, t, c,
               cast((k % 7 = 0) as int) + cast((k % 5 = 0) as int) + cast((k % 11 = 0) as int)
        from f where {REFUSED}""",
)
def _(i: Inputs):
    """Target rows and refused rows of one onboarding: every cell is in one or the other."""
    with _scratch_schema(i.spark) as schema:
        target = f"{schema}.target"
        i.spark.createDataFrame([], "k bigint, d date, t timestamp, c int").write.saveAsTable(target)
        result = onboard_feed(i.spark, i.sql(ONBOARDED), f"{schema}.staging", target, max_issues=None, date_style="MDY")
        good = i.spark.table(target).select(
            F.lit("good").alias("kind"),
            F.col("k").cast("string"),
            F.col("d").cast("string"),
            F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("t"),
            F.col("c").cast("string"),
            F.lit(0).alias("n_issues"),
        )
        bad = result.bad.select(F.lit("bad").alias("kind"), "k", "d", "t", "c", F.size("issues").alias("n_issues"))
        return stage(good.unionByName(bad))


@query(
    "publish_partitions",
    f"""with after as ({APPLIED})
        select c_custkey, c_mktsegment, open_date, close_date, 'close_date' as partition_column, true as kept_others
        from after""",
)
def _(i: Inputs):
    """A type 2 load published into a table partitioned by close date: only the open and the newly closed change."""
    with _scratch_schema(i.spark) as schema:
        table = f"{schema}.dim"
        i.view("scd2_target").write.partitionBy("close_date").saveAsTable(table)
        history = F.col("close_date") < F.lit(EXTRACT_DATE).cast("date") - F.expr("interval 1 day")
        files = lambda: {row[0] for row in i.spark.table(table).where(history).select("_metadata.file_path").distinct().collect()}
        before = files()
        after = scd.scd2_apply(i.spark.table(table), i.view("scd_source"), ["c_custkey"], EXTRACT_DATE)
        catalog.publish_partitions(i.spark, table, after.where(~history))
        parts = [column.name for column in i.spark.catalog.listColumns(table) if column.isPartition]
        return stage(
            i.spark.table(table).select(
                "c_custkey",
                "c_mktsegment",
                "open_date",
                "close_date",
                F.lit(",".join(parts)).alias("partition_column"),
                F.lit(before == files()).alias("kept_others"),
            )
        )


@query(
    "clone_schema",
    "select 'by_status' as table_name, 0 as n_rows, 'o_orderstatus' as partition_column, count(*) as n_source from orders",
)
def _(i: Inputs):
    """A schema cloned without rows, partitioning kept."""
    with _scratch_schema(i.spark) as schema:
        i.table("orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").saveAsTable(f"{schema}.by_status")
        copy = f"{schema}_copy"
        made = catalog.clone_schema(i.spark, schema, copy)
        parts = [column.name for column in i.spark.catalog.listColumns(f"{copy}.{made[0]}") if column.isPartition]
        counts = i.spark.table(f"{copy}.{made[0]}").agg(F.count("*").cast("int").alias("n_rows"))
        source = i.spark.table(f"{schema}.by_status").agg(F.count("*").alias("n_source"))
        result = stage(
            counts.select(F.lit(made[0]).alias("table_name"), "n_rows", F.lit(",".join(parts)).alias("partition_column"), source.scalar().alias("n_source"))
        )
        i.spark.sql(f"drop schema {copy} cascade")
        return result


@query(
    "table_from_sql",
    """select o_orderstatus, count(*) as n_orders from orders group by all""",
)
def _(i: Inputs):
    """Structure cloned, filled from a query, refreshed and read back."""
    with _scratch_schema(i.spark) as schema:
        i.table("orders").createOrReplaceTempView("feedwright_orders")
        made = f"{schema}.by_status"
        catalog.table_from_sql(i.spark, "select o_orderstatus, count(*) as n_orders from feedwright_orders group by 1", made)
        catalog.create_if_missing(i.spark, f"{schema}.copied", made)
        catalog.refresh_view(i.spark, f"select * from {made}", f"{schema}.copied")
        i.spark.catalog.dropTempView("feedwright_orders")
        return stage(i.spark.table(f"{schema}.copied"))


@query(
    "truncate_table",
    "select 0 as n_left, count(*) as n_before, 1 as n_dropped from orders",
)
def _(i: Inputs):
    """Rows before and after a truncate, and the tables a name pattern drops."""
    with _scratch_schema(i.spark) as schema:
        table = f"{schema}.orders_copy"
        i.table("orders").select("o_orderkey").write.saveAsTable(table)
        before = stage(i.spark.table(table).agg(F.count("*").alias("n_before")))
        catalog.truncate_table(i.spark, table)
        left = i.spark.table(table).count()
        dropped = catalog.drop_tables_like(i.spark, schema, "^orders_")
        return before.select(F.lit(left).alias("n_left"), "n_before", F.lit(len(dropped)).alias("n_dropped"))


@query(
    "load_file_table",
    """select cast(o_orderkey as bigint) as o_orderkey, try_cast(o_custkey as integer) as o_custkey, o_orderstatus,
              cast(o_totalprice as decimal(18,2)) as o_totalprice, cast(o_orderdate as date) as o_orderdate,
              o_orderpriority
       from {orders_text} t
       where try_cast(o_custkey as integer) is not null and o_orderdate <> 'n/a'
         and try_cast(o_totalprice as decimal(18,2)) is not null""",
)
def _(i: Inputs):
    """A tab-separated file loaded into a table; rows that do not fit are counted and left out."""
    path = scratch_path(i.spark, "load")
    delimited.write_csv(_orders(i), path, sep="\\t", headers=False)
    with _scratch_schema(i.spark) as schema:
        table = f"{schema}.orders"
        load.load_file(
            i.spark,
            path,
            table,
            T.StructType.fromDDL(TYPED),
            max_bad=2**62,
            write="overwrite",
            preset="mysql",
            date_style="YMD",
        )
        return stage(i.spark.table(table))
