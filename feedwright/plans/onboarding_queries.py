"""File onboarding and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedwright.operators import onboarding
from feedwright.plans.fixtures import Inputs
from feedwright.plans.registry import query

MIXED = (
    "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority all_int small_int signed_decimal "
    "int_and_decimal all_dates date_and_time am_pm padded_code no_value"
).split()

# Classification in SQL: one row per cell, then one row per column.
CELLS = " union all ".join(
    f"select {k + 1} as id, '{name}' as name, {name} as cell from mixed" for k, name in enumerate(MIXED)
)
INFERRED = rf"""
    with mixed as materialized (select * from {{mixed_columns}} m),
    cells as ({CELLS}),
    kinds as (select id, name, cell,
        case when cell is null then null
             when regexp_matches(cell, '^(0|-\d*|[1-9]\d*|)$') then
                 case when cell in ('', '-') or abs(try_cast(cell as bigint)) < 9223372036854775807
                      then 'INT' else 'VARCHAR' end
             when regexp_matches(cell, '^-?(\d*)\.(\d*)$') then 'NUMERIC'
             when regexp_matches(cell, '^(\d+)([-/])(\d+)[-/](\d+)\s\d+(:)?\d+:?[\d.]+\s?(AM|PM)$', 'i') then 'AMPM'
             when regexp_matches(cell, '^(\d+)([-/])(\d+)[-/](\d+)\s\d+(:)?\d+:?[\d.]+\s?$', 'i') then 'DATETIME'
             when regexp_matches(cell, '^(\d+)([-/])(\d+)[-/](\d+)$') then 'DATE' else 'VARCHAR' end as kind
        from cells),
    folded as (select id, name,
        coalesce(bool_or(kind = 'INT'), false) as i, coalesce(bool_or(kind = 'NUMERIC'), false) as n,
        coalesce(bool_or(kind = 'DATE'), false) as d, coalesce(bool_or(kind = 'DATETIME'), false) as t,
        coalesce(bool_or(kind = 'AMPM'), false) as a, coalesce(bool_or(kind = 'VARCHAR'), false) as v,
        max(case when cell is not null then greatest(length(cell), 1) end) as longest,
        max(case when kind = 'INT' then coalesce(abs(try_cast(cell as bigint)), 0) end) as magnitude,
        max(case kind when 'NUMERIC' then length(regexp_extract(cell, '^-?(\d*)\.(\d*)$', 1))
                      when 'INT' then length(replace(cell, '-', '')) end) as ld,
        max(case kind when 'NUMERIC' then length(regexp_extract(cell, '^-?(\d*)\.(\d*)$', 2))
                      when 'INT' then 0 end) as rd
        from kinds group by id, name),
    typed as (select *,
        case when v or a or ((i or n) and (d or t)) or not (i or n or d or t) then 'VARCHAR' when n then 'NUMERIC'
             when i then 'INT' when t then 'DATETIME' else 'DATE' end as logical_type from folded),
    sized as (select *, greatest(coalesce(longest, 100), case when a then 25 else 0 end) as len from typed)"""
VARCHAR_LENGTH = "case when len > 100 or len < 5 then len else 100 end"
WIDTH = """case when magnitude < 127 then 'BYTEINT' when magnitude < 32767 then 'SMALLINT'
                when magnitude < 2147483647 then 'INT' else 'BIGINT' end"""


@query(
    "infer_columns",
    INFERRED
    + f""" select cast(id as integer) as id, name, logical_type,
             cast(case when logical_type = 'VARCHAR' then {VARCHAR_LENGTH} end as integer) as varchar_length,
             case when logical_type = 'INT' then {WIDTH} end as int_width,
             cast(case when logical_type = 'NUMERIC' then ld + rd end as integer) as precision,
             cast(case when logical_type = 'NUMERIC' then rd end as integer) as scale,
             case when a then 'ampm_to_timestamp' end as mangler from sized""",
)
def _(i: Inputs):
    return onboarding.infer_columns(i.view("mixed_columns"))


def _dialect_sql(names: dict[str, str], decimal: str) -> str:
    widths = " ".join(f"when '{width}' then '{names[width]}'" for width in ("BYTEINT", "SMALLINT", "INT", "BIGINT"))
    return (
        INFERRED
        + f""" select cast(id as integer) as id, cast(1 as integer) as include, name,
                 case logical_type when 'VARCHAR' then concat('VARCHAR(', cast({VARCHAR_LENGTH} as varchar), ')')
                      when 'INT' then case {WIDTH} {widths} end
                      when 'NUMERIC' then concat('{decimal}(', cast(ld + rd as varchar), ',', cast(rd as varchar), ')')
                      when 'DATETIME' then '{names['DATETIME']}' else 'DATE' end as type,
                 case when a then 'ampm_to_timestamp' end as mangler, name as originalname from sized"""
    )


for _name, _decimal in (("spark", "DECIMAL"), ("postgres", "NUMERIC"), ("mysql", "NUMERIC"), ("generic", "NUMERIC")):

    @query(
        "infer_types" if _name == "spark" else f"map_inferred_type_{_name}",
        _dialect_sql(onboarding.DIALECTS[_name], _decimal),
    )
    def _(i: Inputs, dialect=_name):
        return onboarding.infer_types(i.view("mixed_columns"), dialect)


@query(
    "map_inferred_type_bigquery",
    INFERRED
    + """ select name, case logical_type when 'INT' then 'INTEGER' when 'DATE' then 'DATE' when 'NUMERIC' then 'FLOAT'
                            else 'STRING' end as type from sized""",
)
def _(i: Inputs):
    return onboarding.infer_types(i.view("mixed_columns"), "bigquery").select("name", "type")


@query(
    "infer_int_width",
    """select o_orderkey, case when o_orderkey < 127 then 'BYTEINT' when o_orderkey < 32767 then 'SMALLINT'
                               when o_orderkey < 2147483647 then 'INT' else 'BIGINT' end as width from orders""",
)
def _(i: Inputs):
    return i.table("orders").select("o_orderkey", onboarding.infer_int_width(F.abs("o_orderkey")).alias("width"))


@query(
    "infer_precision",
    """select event_id, length(split_part(v, '.', 1)) as left_digits, length(split_part(v, '.', 2)) as right_digits
       from (select event_id, cast(abs(cast(value as decimal(18,2))) as varchar) as v from events) e""",
)
def _(i: Inputs):
    cells = i.sql("select event_id, cast(abs(cast(value as decimal(18,2))) as string) as v from {events}")
    left, right = onboarding.infer_precision(F.col("v"), onboarding.classify_cell(F.col("v")))
    return cells.select("event_id", left.alias("left_digits"), right.alias("right_digits"))


@query(
    "size_varchar",
    """select lang, cast(case when n > 100 or n < 5 then n else 100 end as integer) as declared
       from (select lang, max(length(source)) as n from documents group by lang) d""",
)
def _(i: Inputs):
    longest = i.table("documents").groupBy("lang").agg(F.max(F.length("source")).alias("n"))
    return longest.select("lang", onboarding.size_varchar(F.col("n")).cast("int").alias("declared"))


@query(
    "detect_date_style",
    """select 'ymd' as name, case when max(month(o_orderdate)) > 12 then 'YDM' else 'YMD' end as date_style,
              '-' as date_delim from orders
       union all select 'dmy', 'DMY', '/' from orders group by 1
       union all select 'mdy', 'MDY', '/' from orders group by 1
       union all select 'text', null, null from orders group by 1""",
)
def _(i: Inputs):
    written = i.table("orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("ymd"),
        F.date_format("o_orderdate", "d/M/yyyy").alias("dmy"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("mdy"),
        F.col("o_orderpriority").alias("text"),
    )
    return onboarding.detect_date_style(written).drop("time_delim")


@query(
    "mangle_column_names",
    """select o_orderkey as "ORDER_KEY", o_custkey as "CUST_KEY", o_orderstatus as "ORDERSTATUS" from orders""",
)
def _(i: Inputs):
    headed = i.table("orders").select(
        F.col("o_orderkey").alias("o_ORDER KEY"),
        F.col("o_custkey").alias("o_CUST KEY"),
        F.col("o_orderstatus").alias("o_ORDERSTATUS"),
    )
    return onboarding.rename_columns(headed, [("^o_", "")])


@query(
    "table_name_from_path",
    r"""select path, case when regexp_matches(base, '^\d') then concat('D_', base) else base end as table_name
        from (select path, replace(regexp_extract(path, '([\w-]*)\.\w*$', 1), '-', '_') as base from {feed_files} f) b""",
)
def _(i: Inputs):
    return i.view("feed_files").select("path", onboarding.table_name_from_path(F.col("path")).alias("table_name"))


@query(
    "unique_values",
    """select event_type as unique_values, count(*) as "count" from events where event_type is not null group by 1""",
)
def _(i: Inputs):
    return onboarding.unique_values(i.table("events"), "event_type")


PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
COUNTS = " union all ".join(
    f"select {name} as value, count(*) as count_of_field, '{name}' as profiled_field from {{orders_text}} t group by {name} "
    "having count(*) > 10"
    for name in PROFILED
)


@query("profile_preview", COUNTS)
def _(i: Inputs):
    return onboarding.profile_preview(i.view("orders_text"))


@query(
    "profile_table",
    f"""select value, count_of_field, value_percent, profiled_field
        from (select value, count_of_field, profiled_field, value_percent,
                     max(value_percent) over (partition by profiled_field) as best
              from (select *, cast(count_of_field::double / (select count(*) from orders)::double * 100
                                   as decimal(6,3)) as value_percent
                    from ({COUNTS}) c
                    qualify row_number() over (partition by profiled_field
                                               order by count_of_field desc, value nulls last) <= 100) r) b
        where best > 1""",
)
def _(i: Inputs):
    return onboarding.profile_table(i.view("orders_text"))


@query(
    "top_values",
    """select event_type, user_id, n from (
           select event_type, user_id, count(*) as n from events group by all) c
       qualify row_number() over (partition by event_type order by n desc, user_id) <= 5""",
)
def _(i: Inputs):
    counted = i.table("events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return onboarding.top_values(counted, "event_type", [F.desc("n"), F.asc("user_id")], 5)


@query(
    "generate_rows",
    "select count(*) as n_rows, count(*) as n_in_range, count(distinct o_orderkey) as n_serial from orders",
)
def _(i: Inputs):
    """One synthetic row per order; the check is that every value keeps to its type."""
    made = onboarding.generate_rows(
        i.spark,
        "sk bigint, code varchar(8), small smallint, price decimal(9,2), made timestamp, note char(3)",
        seed=3,
        serial=["sk"],
        base=i.table("orders"),
        row_id="o_orderkey",
    )
    fits = (
        (F.length("code") == 8)
        & F.col("small").between(0, 32767)
        & F.col("price").between(0, 9999999.99)
        & (F.length("note") == 3)
        & F.col("made").isNotNull()
    )
    return made.agg(
        F.count("*").alias("n_rows"), F.count_if(fits).alias("n_in_range"), F.countDistinct("sk").alias("n_serial")
    )


@query(
    "conform_feed",
    """select cast(o_orderkey as bigint) as o_orderkey, try_cast(o_custkey as integer) as o_custkey, o_orderstatus,
              try_cast(o_totalprice as decimal(18,2)) as o_totalprice, try_cast(o_orderdate as date) as o_orderdate,
              o_orderpriority from {orders_text} t""",
)
def _(i: Inputs):
    """Text rows to declared types, as the load of a feed does."""
    from pyspark.sql import types as T

    from feedwright.sources.load import cast_rows

    schema = T.StructType.fromDDL(
        "o_orderkey bigint, o_custkey int, o_orderstatus string, o_totalprice decimal(18,2), o_orderdate date, "
        "o_orderpriority string"
    )
    return cast_rows(i.view("orders_text"), schema, date_style="YMD")
