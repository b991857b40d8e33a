"""Scalar expressions, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from feedwright.functions import columns, dates, text, types
from feedwright.plans.fixtures import Inputs
from feedwright.plans.registry import query
from feedwright.sources import catalog, delimited

PRICE = "cast(o_totalprice as decimal(18,2))"


@query("columns_from_source", "select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders")
def _(i: Inputs):
    return columns.columns_from_source(i.table("orders"), ignore=["O_TOTALPRICE", "o_orderdate"])


@query("columns_from_target", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from {scd_source} s")
def _(i: Inputs):
    return columns.columns_from_target(i.view("scd_source"), i.view("scd2_target"), ["open_date", "close_date"])


@query("source_prefixed_columns", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from {scd_source} s")
def _(i: Inputs):
    chosen = columns.source_prefixed_columns(i.view("scd2_target"), ["open_date", "close_date"])
    return i.view("scd_source").alias("source").select(*chosen)


@query(
    "split_columns",
    "select o_custkey, o_orderkey, o_orderstatus from orders",
)
def _(i: Inputs):
    names = [name.lower() for name in columns.split_columns(" o_orderkey , o_custkey,O_ORDERSTATUS ")]
    return i.table("orders").select(*names)


@query(
    "format_by_type",
    f"""select o_orderkey, o_custkey, upper(o_orderstatus) as o_orderstatus,
               {PRICE} as o_totalprice, strftime(o_orderdate, '%Y%m%d') as o_orderdate,
               upper(o_orderpriority) as o_orderpriority from orders""",
)
def _(i: Inputs):
    return columns.format_by_type(
        i.table("orders"),
        {
            "double": lambda c: c.cast("decimal(18,2)"),
            "timestamp_ntz": lambda c: F.date_format(c, "yyyyMMdd"),
            "string": F.upper,
        },
    )


@query(
    "conform_types",
    """select try_cast(o_orderkey as integer) as o_orderkey, try_cast(o_custkey as smallint) as o_custkey,
              o_orderstatus, cast(cast(o_totalprice as decimal(9,0)) as integer) as o_totalprice from orders""",
)
def _(i: Inputs):
    rows = i.sql(
        "select o_orderkey, cast(o_custkey as int) as o_custkey, o_orderstatus, "
        "cast(o_totalprice as decimal(9,0)) as o_totalprice from {orders}"
    )
    return types.conform_types(rows, {"bigint": T.IntegerType(), "int": "smallint", "{NUMBER}": ""})


@query(
    "conform_by_table",
    "select p_partkey, p_name, p_brand, p_type, cast(p_size as bigint) as p_size from part",
)
def _(i: Inputs):
    mappings = i.sql(
        "select distinct 'spark' as source_db_type, 'int' as source_column_type, 'warehouse' as target_db_type, "
        "'bigint' as target_column_type from {region}"
    )
    return types.conform_by_table(i.table("part").drop("p_retailprice"), mappings, "spark", "warehouse")


@query(
    "encrypt_columns",
    """select c_custkey, to_base64(unhex(sha256(c_name))) as c_name, c_nationkey,
              to_base64(unhex(sha256(c_mktsegment))) as c_mktsegment from customer""",
)
def _(i: Inputs):
    rows = i.table("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return text.encrypt_columns(rows, ["C_NAME", "c_mktsegment"])


@query("coalesce_text", "select o_orderkey, coalesce(o_orderpriority, 'none') as o_orderpriority from {orders_text} t")
def _(i: Inputs):
    return i.view("orders_text").select(
        "o_orderkey", text.coalesce_text(F.col("o_orderpriority"), "none").alias("o_orderpriority")
    )


CONCAT = f"""concat(cast(o_custkey as varchar), o_orderstatus, cast({PRICE} as varchar),
                    cast(cast(o_orderdate as date) as varchar), coalesce(nullif(o_orderpriority, '5-LOW'), ''))"""
HASH_INPUT = (
    "select o_orderkey, o_custkey, o_orderstatus, cast(o_totalprice as decimal(18,2)) as o_totalprice, "
    "cast(o_orderdate as date) as o_orderdate, nullif(o_orderpriority, '5-LOW') as o_orderpriority from {orders}"
)


@query("concat_columns", f"select o_orderkey, {CONCAT} as joined from orders")
def _(i: Inputs):
    rows = i.sql(HASH_INPUT)
    return rows.select("o_orderkey", text.concat_columns(rows, rows.columns[1:]).alias("joined"))


@query("row_hash", f"select o_orderkey, concat('0x', upper(md5({CONCAT}))) as hash_value from orders")
def _(i: Inputs):
    return text.row_hash(i.sql(HASH_INPUT), ["o_orderkey"])


@query(
    "comparison_pk",
    "select concat(cast(l_orderkey as varchar), ',', cast(l_linenumber as varchar)) as pk, l_partkey from lineitem",
)
def _(i: Inputs):
    return i.table("lineitem").select(text.comparison_pk(["l_orderkey", "l_linenumber"]).alias("pk"), "l_partkey")


@query("replace_text", "select p_partkey, replace(p_name, 'red', 'crimson') as p_name from part")
def _(i: Inputs):
    return i.table("part").select("p_partkey", text.replace_text(F.col("p_name"), "red", "crimson").alias("p_name"))


@query(
    "escape_text",
    r"""select event_id, replace(replace(props, '\', '\\'), '"', '\"') as props from events""",
)
def _(i: Inputs):
    return i.table("events").select("event_id", text.escape_text(F.col("props"), '\\"').alias("props"))


@query(
    "fix_code_page",
    """select doc_id, translate(concat(text, chr(128), chr(154)), concat(chr(128), chr(138), chr(140), chr(142), chr(154),
              chr(156), chr(158), chr(159)), concat(chr(164), chr(166), chr(188), chr(180), chr(168), chr(189),
              chr(184), chr(190))) as text from documents""",
)
def _(i: Inputs):
    odd = F.concat("text", F.lit("\u0080\u009a"))
    return i.table("documents").select("doc_id", text.fix_code_page(odd).alias("text"))


@query("change_case_data", "select conv_id, turn, upper(role) as role from conversations")
def _(i: Inputs):
    return text.change_case_data(i.table("conversations").select("conv_id", "turn", "role"), "upper")


@query("text_length", "select cast(max(length(text)) as integer) as character_length from documents")
def _(i: Inputs):
    return text.text_length(i.table("documents"), "text")


@query(
    "text_length_filtered",
    "select cast(length(p_name) as integer) as character_length from part where p_size > 25",
)
def _(i: Inputs):
    return text.text_length(i.table("part"), "p_name", "p_size > 25")


@query("code_point", "select doc_id, unicode(text) as first_code from documents")
def _(i: Inputs):
    return i.table("documents").select("doc_id", text.code_point(F.col("text")).alias("first_code"))


@query("count_records", "select count(*) as n_records from lineitem where l_quantity > 25")
def _(i: Inputs):
    return columns.count_records(i.table("lineitem"), "where l_quantity > 25")


@query(
    "ampm_to_timestamp",
    """select event_id, case when event_id % 4 = 3 then null
                             when event_id % 4 = 2 then strftime(ts, '%Y-%m-%d 00:00:00')
                             else strftime(ts, '%Y-%m-%d %H:%M:%S') end as read_back
       from events""",
)
def _(i: Inputs):
    written = (
        F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy/M/d h:mm:ss a"))
        .when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise("n/a")
    )
    return i.table("events").select(
        "event_id", F.date_format(dates.ampm_to_timestamp(written), "yyyy-MM-dd HH:mm:ss").alias("read_back")
    )


@query("json_args", "select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events")
def _(i: Inputs):
    return i.table("events").select("event_id", columns.json_args(F.col("props"))["k"].cast("int").alias("k"))


@query(
    "layered_default",
    """select event_id, coalesce(case when event_id % 3 = 0 then event_type end,
                                 case when event_id % 2 = 0 then json_extract_string(props, '$.k') end, 'default')
                        as value
       from events""",
)
def _(i: Inputs):
    return i.table("events").select(
        "event_id",
        columns.layered_default(
            F.when(F.col("event_id") % 3 == 0, F.col("event_type")),
            F.when(F.col("event_id") % 2 == 0, columns.json_args(F.col("props"))["k"]),
            F.lit("default"),
        ).alias("value"),
    )


@query(
    "resolve_params",
    """select p_partkey as step, p_brand as template_name, p_type as param_name,
              coalesce(case when p_size % 2 = 0 then p_name end,
                       case when p_size % 3 = 0 then concat('arg', cast(p_size as varchar)) end, d.param_default)
                  as param_resolved,
              case when p_size % 2 = 0 then 1 else 0 end as defined
       from part join (select p_brand as b, p_type as t, min(p_name) as param_default from part group by all) d
            on b = p_brand and t = p_type""",
)
def _(i: Inputs):
    params = i.sql(
        "select p_brand as template_name, p_type as param_name, min(p_name) as param_default from {part} "
        "group by p_brand, p_type"
    )
    values = i.sql(
        "select p_brand as template_name, p_type as param_name, p_partkey as step, "
        "case when p_size % 2 = 0 then p_name end as param_value, "
        "case when p_size % 3 = 0 then map(p_type, concat('arg', p_size)) else cast(map() as map<string,string>) end "
        "as job_args from {part}"
    )
    resolved = columns.resolve_params(params, values, job_args=F.col("job_args"))
    return resolved.select("step", "template_name", "param_name", "param_resolved", "defined")


@query(
    "normalise_extract_date",
    """select event_id, case event_id % 4 when 0 then strftime(ts, '%Y-%m-%d')
                                          when 3 then null else strftime(ts, '%Y-%m-%d %H:%M:%S') end as extract_date
       from events""",
)
def _(i: Inputs):
    written = (
        F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyyMMdd"))
        .when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyyMMddHHmmss"))
        .when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
        .otherwise("undated")
    )
    return i.table("events").select("event_id", dates.normalise_extract_date(written).alias("extract_date"))


@query(
    "qualified_target",
    """select load_execution_id,
              coalesce(target_db_name, '') || '.' || coalesce(target_schema_name, '') || '.'
              || coalesce(target_table_name, '') as target
       from {load_execution} l""",
)
def _(i: Inputs):
    return i.view("load_execution").select(
        "load_execution_id",
        columns.qualified_target(
            F.col("target_db_name"), F.col("target_schema_name"), F.col("target_table_name")
        ).alias("target"),
    )


@query("optional_filter", "select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F' and o_custkey > 10")
def _(i: Inputs):
    rows = columns.optional_filter(i.table("orders"), "where o_orderstatus = 'F' and o_custkey > 10")
    return rows.select("o_orderkey", "o_orderstatus")


@query(
    "delta_filter",
    """select o_orderkey, o_custkey from orders
       where o_orderdate > (select max(o_orderdate) from orders where o_orderdate < timestamp '1998-01-01')""",
)
def _(i: Inputs):
    orders = i.table("orders")
    loaded = orders.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return columns.delta_filter(orders, loaded, "o_orderdate").select("o_orderkey", "o_custkey")


@query("stamp_columns", "select c_custkey, c_name, cast(7 as integer) as job_id, upper(c_name) as shout from customer")
def _(i: Inputs):
    rows = i.table("customer").select("c_custkey", "c_name")
    return columns.stamp_columns(rows, {"job_id": 7, "shout": F.upper("c_name")})


@query("safe_identifier", 'select o_orderkey as "select", o_custkey as "odd name" from orders')
def _(i: Inputs):
    renamed = i.table("orders").select(F.col("o_orderkey").alias("select"), F.col("o_custkey").alias("odd name"))
    return renamed.selectExpr(text.safe_identifier("select"), text.safe_identifier("odd name"))


@query(
    "run_sql",
    """select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(18,2))) as decimal(28,2)) as sum_qty,
              count(*) as count_order
       from lineitem where l_shipdate <= timestamp '2000-09-02' group by all""",
)
def _(i: Inputs):
    return catalog.run_sql(
        i.spark,
        "select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(18,2))) as decimal(28,2)) as sum_qty, "
        "count(*) as count_order from {lineitem} where l_shipdate <= cast(:until as timestamp_ntz) "
        "group by l_returnflag, l_linestatus",
        {"until": "2000-09-02"},
        lineitem=i.table("lineitem"),
    )


@query("preview", "select least(count(*), 1000) as n_rows from orders")
def _(i: Inputs):
    return delimited.preview(i.table("orders")).agg(F.count("*").alias("n_rows"))


@query(
    "materialize_temp",
    "select c_mktsegment, count(*) as n from customer group by all",
)
def _(i: Inputs):
    catalog.materialize_temp(i.table("customer"), "feedwright_customers", cache=False)
    counted = i.spark.sql("select c_mktsegment, count(*) as n from feedwright_customers group by c_mktsegment")
    i.spark.catalog.dropTempView("feedwright_customers")
    return counted
