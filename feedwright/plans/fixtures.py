"""Input views derived from the given tables, as SQL text that Spark and DuckDB both read.

``{name}`` stands for a given table or another view. Every view is computed over its whole table; the modulo conditions
decide which rows carry which kind of change or fault, they select nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

EXTRACT_DATE = "2024-01-15"
# A table or view name; braces around digits are regex counts.
NAME = r"\{([a-z]\w*)\}"

VIEWS = {
    "scd_source": """
        select c_custkey, c_name, c_nationkey, cast(c_acctbal as decimal(18,2)) as c_acctbal, c_mktsegment
        from {customer} where c_custkey % 11 <> 0""",
    "scd2_target": """
        select c_custkey, c_name, c_nationkey, cast(c_acctbal as decimal(18,2)) as c_acctbal,
               case when c_custkey % 13 = 0 then null when c_custkey % 7 = 0 then 'OLD' else c_mktsegment end
                   as c_mktsegment,
               date '2023-01-01' as open_date, date '2999-12-31' as close_date
        from {customer} where c_custkey % 10 <> 0
        union all
        select c_custkey, c_name, c_nationkey, cast(0 as decimal(18,2)), 'CLOSED', date '2022-01-01', date '2022-12-31'
        from {customer} where c_custkey % 17 = 0""",
    "open_target": """
        select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
        from {scd2_target} where close_date = date '2999-12-31'""",
    "scd1_target": """
        select c_custkey + 1 as customer_sk, c_custkey, c_name, c_nationkey,
               cast(c_acctbal as decimal(18,2)) as c_acctbal,
               case when c_custkey % 13 = 0 then null when c_custkey % 7 = 0 then 'OLD' else c_mktsegment end
                   as c_mktsegment
        from {customer} where c_custkey % 10 <> 0""",
    "orders_text": """
        select cast(o_orderkey as string) as o_orderkey,
               case when o_orderkey % 19 = 0 then '007' when o_orderkey % 23 = 0 then '99999999999'
                    else cast(o_custkey as string) end as o_custkey,
               case when o_orderkey % 29 = 0 then 'XX' else o_orderstatus end as o_orderstatus,
               case when o_orderkey % 31 = 0 then '1e5' when o_orderkey % 37 = 0 then '123456789.12'
                    else cast(cast(o_totalprice as decimal(18,2)) as string) end as o_totalprice,
               case when o_orderkey % 41 = 0 then 'n/a' else cast(cast(o_orderdate as date) as string) end
                   as o_orderdate,
               case when o_orderkey % 43 = 0 then null else o_orderpriority end as o_orderpriority
        from {orders}""",
    "mixed_columns": """
        select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
               o_orderkey as all_int, cast(cast(o_orderkey as bigint) % 100 as string) as small_int,
               concat(cast(cast(o_orderkey as bigint) % 1000 - 500 as string), '.25') as signed_decimal,
               case when cast(o_orderkey as bigint) % 5 = 0 then '12' else '3.5' end as int_and_decimal,
               concat('20', cast(10 + cast(o_orderkey as bigint) % 14 as string), '-03-1',
                      cast(cast(o_orderkey as bigint) % 10 as string)) as all_dates,
               case when cast(o_orderkey as bigint) % 2 = 0 then '2020-01-31' else '2020-01-31 10:20:30' end
                   as date_and_time,
               concat('1/2/2020 ', cast(1 + cast(o_orderkey as bigint) % 12 as string), ':02:03 PM') as am_pm,
               concat('00', cast(cast(o_orderkey as bigint) % 9 as string)) as padded_code,
               cast(null as string) as no_value
        from {orders_text}""",
    "log_lines": """
        select event_id as line_no,
               case when event_id % 60 = 0 then '# comment' when event_id % 50 = 0 then 'garbage'
                    else concat(cast(event_id as string), ' [', event_type, '] user=', cast(user_id as string), ' v=',
                                cast(cast(value as decimal(18,2)) as string)) end as value
        from {events}""",
    "reject_log": """
        select event_id as line_no,
               case when event_id % 4 = 0 then 'loader note'
                    else concat(cast(event_id as string), ': ', cast(event_id * 3 as string), '(',
                                cast(event_id % 97 as string), ') [', cast(event_id % 9 as string),
                                ', VARCHAR(5)] text field too long, "', event_type, '"[', substring(event_type, 1, 1),
                                ']') end as value
        from {events}""",
    "reject_records": """
        select event_id as line_no, concat(cast(event_id as string), '|', event_type, '|', cast(user_id as string))
               as value
        from {events} where event_id % 4 <> 0""",
    "feed_files": """
        select concat('/feeds/', file) as path, file,
               o_orderkey % 7 + 10 as first_line_length
        from (select o_orderkey,
                     case when o_orderkey % 3 = 0
                          then concat('orders_', replace(cast(cast(o_orderdate as date) as string), '-', ''), '_',
                                      cast(o_orderkey as string), '.csv')
                          when o_orderkey % 3 = 1
                          then concat('ORDERS-', cast(cast(o_orderdate as date) as string), '-',
                                      cast(o_orderkey as string), '.csv')
                          else concat('readme_', cast(o_orderkey as string), '.txt') end as file
              from {orders}) f""",
    "batch_ctl": """
        select user_id as batch_id, concat('group_', cast(user_id % 7 as string)) as batch_identifier,
               min(ts) as start_ts, max(ts) as end_ts, 'COMPLETE' as status,
               max(abs(cast(floor(value) as bigint))) as processing_time
        from {events} group by user_id""",
    "job_ctl": """
        select event_id as job_id, user_id as batch_id, concat('file_', cast(event_id as string)) as identifier,
               concat('feed_', cast(user_id % 20 as string)) as processing_group_name, ts as extract_ts, ts as start_ts,
               ts as end_ts,
               case when event_id % 31 = 0 then 'ERROR' when event_id % 37 = 0 then 'RUNNING' else 'COMPLETE' end
                   as status,
               abs(cast(floor(value) as bigint)) as processing_time
        from {events} where event_id % 5 <> 0""",
    "load_execution": """
        select event_id * 10 + 1 as load_execution_id, event_id as job_id, 1 as sequence_order,
               case when event_id % 6 = 0 then null else 'warehouse' end as target_db_name,
               'staging' as target_schema_name, event_type as target_table_name,
               abs(cast(floor(value) as bigint)) as processing_time, event_id % 1000 as rows_affected,
               cast(null as string) as warnings, cast(null as string) as perf_stats, 'DATACOP' as template_name
        from {events} where event_id % 5 <> 0
        union all
        select event_id * 10 + 2, event_id, 2, 'warehouse', 'core', event_type, abs(cast(floor(value) as bigint)),
               event_id % 500, cast(null as string), cast(null as string), 'SQL'
        from {events} where event_id % 5 <> 0""",
    "config": """
        select 'nightly' as processing_group_name, o_custkey as sequence_order,
               cast(floor(o_custkey / 10) as bigint) as parent_sequence_order, 'SQL' as template_name,
               case when o_custkey % 97 = 0 then 1 else 0 end as disable_flag
        from {orders} where o_custkey > 0 group by o_custkey""",
    "lock_waits": """
        select c_custkey as waiting, case when c_custkey % 50 = 3 then c_custkey
                                          else cast(floor(c_custkey / 3) as bigint) end as blocking
        from {customer} where c_custkey > 5
        union all
        select c_custkey, cast(floor(c_custkey / 2) as bigint) from {customer} where c_custkey > 5 and c_custkey % 7 = 0""",
    "documents_parts": """
        select doc_id, text from {documents}""",
}


def view_sql(name: str, spark_side: bool = False) -> str:
    """Text of a view with other views inlined; given tables stay ``{name}`` on the Spark side."""

    def inline(match: re.Match) -> str:
        inner = match.group(1)
        if inner in VIEWS:
            return f"({view_sql(inner, spark_side)})"
        return "{" + inner + "}" if spark_side else inner

    return re.sub(NAME, inline, VIEWS[name])


class Inputs:
    """Tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return self.sql(view_sql(name, spark_side=True))

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over ``{table}`` and ``{view}`` names."""
        text = re.sub(
            NAME,
            lambda m: f"({view_sql(m.group(1), True)}) as {m.group(1)}" if m.group(1) in VIEWS else m.group(0),
            text,
        )
        names = set(re.findall(NAME, text))
        return self.spark.sql(text, **{name: self.table(name) for name in names})


def with_views(sql: str) -> str:
    """DuckDB text in which every ``{view}`` is inlined and every ``{table}`` is the table."""
    return re.sub(
        NAME,
        lambda m: f"({view_sql(m.group(1))})" if m.group(1) in VIEWS else m.group(1),
        sql,
    )
