"""Feed validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedwright.functions.text import global_substitute
from feedwright.operators import quality
from feedwright.plans.fixtures import Inputs
from feedwright.plans.registry import query
from feedwright.sources import delimited, logs

DECLARED = (
    "o_orderkey bigint, o_custkey int, o_orderstatus char(1), o_totalprice decimal(8,2), o_orderdate date, "
    "o_orderpriority varchar(15)"
)
TARGET = (7, "warehouse", "staging", "orders")

DATE_OK = r"regexp_matches(%s, '^(\d+)([-/])(\d+)[-/](\d+)$')"
TIMESTAMP_OK = r"regexp_matches(%s, '^(\d+)([-/])(\d+)[-/](\d+)\s\d+(:)?\d+:?[\d.]+\s?(AM|PM)?$', 'i')"


def int_issue(column: str, bound: int | None) -> str:
    number = f"try_cast(trim({column}) as bigint)"
    overflow = (
        ""
        if bound is None
        else f"when coalesce({number}, 0) <= -{bound} or coalesce({number}, 0) >= {bound} then 'NUMERIC_OVERFLOW'"
    )
    return rf"""case when {column} is null then null
        when regexp_matches({column}, '^0\d+$') or not regexp_matches({column}, '^\s*-?\d*$') then 'DATA_TYPE_MISMATCH'
        when not regexp_matches({column}, '^\s*-?$') and {number} is null then 'DATA_TYPE_MISMATCH'
        {overflow} end"""


def numeric_issue(column: str, precision: int, scale: int) -> str:
    left = rf"length(regexp_extract({column}, '^-?(\d*)\.?(\d*)$', 1))"
    right = rf"length(regexp_extract({column}, '^-?(\d*)\.?(\d*)$', 2))"
    return rf"""case when {column} is null then null
        when not regexp_matches({column}, '^-?\d*\.?\d*$') then 'DATA_TYPE_MISMATCH'
        when {left} + {right} > {precision} or {right} > {scale} then 'NUMERIC_OVERFLOW' end"""


def char_issue(column: str, length: int) -> str:
    return f"case when greatest(length({column}), 1) > {length} and {column} is not null then 'MAX_LENGTH_EXCEEDED' end"


ISSUES = {
    "o_orderkey": int_issue("o_orderkey", None),
    "o_custkey": int_issue("o_custkey", 2147483648),
    "o_orderstatus": char_issue("o_orderstatus", 1),
    "o_totalprice": numeric_issue("o_totalprice", 8, 2),
    "o_orderdate": f"case when not {DATE_OK % 'o_orderdate'} then 'DATA_TYPE_MISMATCH' end",
    "o_orderpriority": char_issue("o_orderpriority", 15),
}
TYPES = {
    "o_orderkey": ("bigint", "Size: [4]"),
    "o_custkey": ("int", "Size: [3]"),
    "o_orderstatus": ("char", "Length: [1]"),
    "o_totalprice": ("decimal", "Scale: [8], Precision: [2]"),
    "o_orderdate": ("date", None),
    "o_orderpriority": ("varchar", "Length: [15]"),
}
FIRST_ISSUE = "coalesce(" + ", ".join(f"({sql})" for sql in ISSUES.values()) + ")"
NAMES = ", ".join(ISSUES)
PER_CELL = " union all ".join(
    f"select o_orderkey as row_no, {position} as column_position, '{name}' as column_name, {name} as data_item, "
    f"({sql}) as issue_type from {{orders_text}} t{position}"
    for position, (name, sql) in enumerate(ISSUES.items())
)


def _orders(i: Inputs, **options):
    return quality.datacop(i.view("orders_text"), DECLARED, *TARGET, **options)


@query("datacop_split", f"select {NAMES} from {{orders_text}} t where {FIRST_ISSUE} is null")
def _(i: Inputs):
    """Good rows."""
    return _orders(i).good


@query("datacop_bad", f"select {NAMES} from {{orders_text}} t where {FIRST_ISSUE} is not null")
def _(i: Inputs):
    return _orders(i).bad.drop("issues")


@query(
    "datacop_totals",
    f"""select cast(7 as bigint) as job_id, 'warehouse' as database_name, 'staging' as schema_name,
               'orders' as table_name, count(*) filter (where {FIRST_ISSUE} is null) as records_validated,
               count(*) filter (where {FIRST_ISSUE} is not null) as records_rejected
        from {{orders_text}} t""",
)
def _(i: Inputs):
    return _orders(i).totals


@query(
    "datacop_issues_summary",
    f"""select cast(7 as bigint) as job_id, 'warehouse' as database_name, 'staging' as schema_name,
               'orders' as table_name, column_name,
               case column_name {' '.join(f"when '{n}' then '{t[0]}'" for n, t in TYPES.items())} end as column_type,
               case column_name {' '.join(f"when '{n}' then '{t[1]}'" for n, t in TYPES.items() if t[1])} end
                   as column_type_extra,
               issue_type, count(*) as issue_count
        from ({PER_CELL}) c where issue_type is not null group by all""",
)
def _(i: Inputs):
    return _orders(i).summary


@query(
    "datacop_row_report",
    f"""select cast(row_no as bigint) as row_no,
               dense_rank() over (order by cast(row_no as bigint)) + 1 as bad_record_no,
               column_position, column_name, data_item, issue_type
        from ({PER_CELL}) c where issue_type is not null""",
)
def _(i: Inputs):
    rows = i.view("orders_text").withColumn("row_no", F.col("o_orderkey").cast("bigint"))
    annotated = quality.annotate(rows, DECLARED, keep=["row_no"])
    return quality.datacop_row_report(annotated, "row_no", with_bad_record_no=True).drop("message")


@query(
    "global_substitute",
    f"""select count(*) as n_rows, count(*) filter (where {FIRST_ISSUE} is null) as n_good
        from (select o_orderkey, o_custkey, regexp_replace(o_orderstatus, '^X+$', 'X', 'g') as o_orderstatus,
                     o_totalprice, o_orderdate, o_orderpriority from {{orders_text}} r) t""",
)
def _(i: Inputs):
    result = _orders(i, global_sub=("^X+$", "X"))
    return result.totals.select(
        (F.col("records_validated") + F.col("records_rejected")).alias("n_rows"),
        F.col("records_validated").alias("n_good"),
    )


def _single(name: str, view_column: str, oracle_issue: str, check):
    """Register one cell check over a column of the order texts."""
    texts = f"select o_orderkey as row_id, {view_column} as cell from {{orders_text}}"

    @query(name, f"select row_id, cell, {oracle_issue} as issue from ({texts}) t")
    def _(i: Inputs):
        cells = i.sql(texts)
        return cells.select("row_id", "cell", F.when(F.col("cell").isNotNull(), check("cell")).alias("issue"))


_single("validate_char", "o_orderstatus", char_issue("cell", 1), lambda c: quality.validate_char(c, 1))
_single("validate_date", "o_orderdate", f"case when not {DATE_OK % 'cell'} then 'DATA_TYPE_MISMATCH' end", quality.validate_date)
_single(
    "validate_timestamp",
    "case when o_orderkey like '%7' then concat(o_orderdate, ' 10:20:30 pm') "
    "when o_orderkey like '%3' then '10:20' else o_orderdate end",
    f"case when not ({DATE_OK % 'cell'} or {TIMESTAMP_OK % 'cell'}) then 'DATA_TYPE_MISMATCH' end",
    quality.validate_timestamp,
)
_single("validate_int", "o_custkey", int_issue("cell", 2147483648), lambda c: quality.validate_int(c, "int"))
_single("validate_smallint", "o_orderkey", int_issue("cell", 32768), lambda c: quality.validate_int(c, "smallint"))
_single("validate_numeric", "o_totalprice", numeric_issue("cell", 8, 2), lambda c: quality.validate_numeric(c, 8, 2))
_single(
    "validate_numeric_strict",
    "o_totalprice",
    r"case when cell is null then null when not regexp_matches(cell, '^-?\d*\.?\d*$') then 'DATA_TYPE_MISMATCH' "
    r"when length(regexp_extract(cell, '^-?(\d*)\.?(\d*)$', 1)) + length(regexp_extract(cell, '^-?(\d*)\.?(\d*)$', 2)) > 8 "
    r"or length(regexp_extract(cell, '^-?(\d*)\.?(\d*)$', 2)) > 2 "
    r"or length(regexp_extract(cell, '^-?(\d*)\.?(\d*)$', 1)) > 6 then 'NUMERIC_OVERFLOW' end",
    lambda c: quality.validate_numeric(c, 8, 2, strict=True),
)

WIDTHS = """select o_orderkey, case when o_orderkey % 5 = 0 then 2 when o_orderkey % 7 = 0 then 4 else 3 end as width
            from orders"""


def _ragged(i: Inputs):
    """Lines of two, three or four cells, parsed to three columns."""
    lines = i.table("orders").select(
        F.concat_ws(
            ",",
            F.col("o_orderkey").cast("string"),
            "o_orderstatus",
            F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey").cast("string")),
            F.when((F.col("o_orderkey") % 5 != 0) & (F.col("o_orderkey") % 7 == 0), F.lit("extra")),
        ).alias("value")
    )
    return delimited.parse_delimited_lines(lines, ["o_orderkey", "o_orderstatus", "o_custkey"], corrupt=True)


RAGGED_SCHEMA = "o_orderkey bigint, o_orderstatus char(1), o_custkey bigint"


@query(
    "check_column_count",
    f"""select case when width = 3 then 'good' else 'COLUMN_COUNT' end as verdict, count(*) as n_rows
        from ({WIDTHS}) w group by all""",
)
def _(i: Inputs):
    annotated = quality.annotate(_ragged(i), RAGGED_SCHEMA)
    return annotated.groupBy(F.coalesce("_any_issue", F.lit("good")).alias("verdict")).agg(F.count("*").alias("n_rows"))


@query(
    "mangle_column_count",
    """select cast(o_orderkey as varchar) as o_orderkey, o_orderstatus,
              case when o_orderkey % 5 <> 0 then cast(o_custkey as varchar) end as o_custkey from orders""",
)
def _(i: Inputs):
    return quality.datacop(_ragged(i), RAGGED_SCHEMA, mangle_column_count=True).good


@query("strip_extra_columns", f"select o_orderkey, o_custkey, o_orderstatus from {{orders_text}} t")
def _(i: Inputs):
    return quality.strip_extra_columns(i.view("orders_text"), 3)


@query(
    "regex_validators",
    rf"""select {NAMES} from {{orders_text}} t
         where regexp_matches(coalesce(o_totalprice, ''), '^\d+\.\d+$', 'i')
           and regexp_matches(coalesce(o_orderpriority, ''), 'urgent|high', 'i')""",
)
def _(i: Inputs):
    return delimited.regex_validators(
        i.view("orders_text"), {"o_totalprice": r"^\d+\.\d+$", "o_orderpriority": "urgent|high"}
    )


@query(
    "csv_to_ndjson",
    r"""select count(*) filter (where a and b) as rows_kept, count(*) filter (where not (a and b)) as rows_dropped,
               count(*) filter (where not a) as failed_o_totalprice,
               count(*) filter (where not b) as failed_o_orderpriority
        from (select regexp_matches(coalesce(o_totalprice, ''), '^\d+\.\d+$', 'i') as a,
                     regexp_matches(coalesce(o_orderpriority, ''), 'urgent|high', 'i') as b from {orders_text} t) v""",
)
def _(i: Inputs):
    return delimited.csv_to_ndjson(
        i.view("orders_text"), None, {"o_totalprice": r"^\d+\.\d+$", "o_orderpriority": "urgent|high"}
    )[1]


@query(
    "downgrade_errors",
    """select event_type, case when regexp_matches(event_type, '^(view|click)$') then 'WARNING' else 'ERROR' end
                  as severity, count(*) as n from events group by all""",
)
def _(i: Inputs):
    return (
        logs.downgrade_errors(i.table("events").select("event_type"), "event_type", ["^view$", "^click$"])
        .groupBy("event_type", "severity")
        .agg(F.count("*").alias("n"))
    )


@query(
    "strip_newlines",
    """select conv_id, turn, translate(role, chr(10), chr(13)) as role, translate(text, chr(10), chr(13)) as text
       from conversations""",
)
def _(i: Inputs):
    from feedwright.functions.text import strip_newlines

    return strip_newlines(i.table("conversations"))


@query("substitute_cells", r"select conv_id, turn, regexp_replace(role, '[aeiou]', '_', 'g') as role from conversations")
def _(i: Inputs):
    return global_substitute(i.table("conversations").select("conv_id", "turn", "role"), "[aeiou]", "_")
