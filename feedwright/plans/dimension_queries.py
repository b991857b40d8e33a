"""Joins, slowly changing dimensions and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedwright.operators import joins, maintenance, reconcile, scd
from feedwright.plans.fixtures import EXTRACT_DATE, Inputs
from feedwright.plans.registry import query

KEYS = ["c_custkey"]
COLUMNS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
DATED = COLUMNS + ", open_date, close_date"
CHANGED = """(s.c_name is distinct from t.c_name or s.c_nationkey is distinct from t.c_nationkey
              or s.c_acctbal is distinct from t.c_acctbal or s.c_mktsegment is distinct from t.c_mktsegment)"""
CLOSE_CHANGED = f"""
    select t.c_custkey, t.c_name, t.c_nationkey, t.c_acctbal, t.c_mktsegment, t.open_date,
           case when t.close_date = date '2999-12-31' and exists (
                    select 1 from {{scd_source}} s where s.c_custkey = t.c_custkey and {CHANGED})
                then date '2024-01-14' else t.close_date end as close_date
    from {{scd2_target}} t"""
CLOSE_MISSING = """
    select t.c_custkey, t.c_name, t.c_nationkey, t.c_acctbal, t.c_mktsegment, t.open_date,
           case when t.close_date = date '2999-12-31' and not exists (
                    select 1 from {scd_source} s where s.c_custkey = t.c_custkey)
                then date '2024-01-14' else t.close_date end as close_date
    from %s t"""
INSERT_NEW = f"""
    select {DATED} from %s a
    union all
    select s.c_custkey, s.c_name, s.c_nationkey, s.c_acctbal, s.c_mktsegment, date '2024-01-15', date '2999-12-31'
    from {{scd_source}} s
    where not exists (select 1 from %s t where t.c_custkey = s.c_custkey and t.close_date = date '2999-12-31')"""
APPLIED = (
    f"with one as ({CLOSE_CHANGED}), two as ({CLOSE_MISSING % 'one'}) " + INSERT_NEW % ("two", "two")
)


@query("scd2_apply", APPLIED)
def _(i: Inputs):
    """Flagship: close changed, close missing, insert new."""
    return scd.scd2_apply(i.view("scd2_target"), i.view("scd_source"), KEYS, EXTRACT_DATE)


@query("scd2_apply_unique", APPLIED)
def _(i: Inputs):
    return scd.scd2_apply_unique(i.view("scd2_target"), i.view("scd_source"), KEYS, EXTRACT_DATE)


@query("scd2_close_changed", CLOSE_CHANGED)
def _(i: Inputs):
    return scd.scd2_close_changed(i.view("scd2_target"), i.view("scd_source"), KEYS, EXTRACT_DATE)


@query("scd2_close_missing", CLOSE_MISSING % "{scd2_target}")
def _(i: Inputs):
    return scd.scd2_close_missing(i.view("scd2_target"), i.view("scd_source"), KEYS, EXTRACT_DATE)


@query("scd2_insert_new", INSERT_NEW % ("{scd2_target}", "{scd2_target}"))
def _(i: Inputs):
    return scd.scd2_insert_new(i.view("scd2_target"), i.view("scd_source"), KEYS, EXTRACT_DATE)


@query(
    "scd1_insert_new",
    f"""select customer_sk, {COLUMNS} from {{scd1_target}} a
        union all
        select row_number() over (order by s.c_custkey) + (select max(customer_sk) from {{scd1_target}} m),
               s.c_custkey, s.c_name, s.c_nationkey, s.c_acctbal, s.c_mktsegment
        from {{scd_source}} s
        where not exists (select 1 from {{scd1_target}} t where t.c_custkey = s.c_custkey)""",
)
def _(i: Inputs):
    return scd.scd1_insert_new(i.view("scd1_target"), i.view("scd_source"), KEYS, "customer_sk")


@query(
    "scd1_rewrite_changed",
    """select t.customer_sk, t.c_custkey,
              case when s.c_custkey is null then t.c_name else s.c_name end as c_name,
              case when s.c_custkey is null then t.c_nationkey else s.c_nationkey end as c_nationkey,
              case when s.c_custkey is null then t.c_acctbal else s.c_acctbal end as c_acctbal,
              case when s.c_custkey is null then t.c_mktsegment else s.c_mktsegment end as c_mktsegment
       from {scd1_target} t left join {scd_source} s on s.c_custkey = t.c_custkey""",
)
def _(i: Inputs):
    return scd.scd1_rewrite_changed(i.view("scd1_target"), i.view("scd_source"), KEYS, "customer_sk")


@query(
    "assign_surrogate_keys",
    """select row_number() over (order by o_orderkey) + 1000 as order_sk, o_orderkey, o_custkey from orders""",
)
def _(i: Inputs):
    from feedwright.operators.numbering import assign_surrogate_keys

    return assign_surrogate_keys(
        i.table("orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], "order_sk", 1000
    )


@query(
    "merge_new_columns",
    """select c_custkey, c_name, c_nationkey, cast(c_acctbal as decimal(18,2)) as c_acctbal,
              cast(null as varchar) as c_mktsegment from customer""",
)
def _(i: Inputs):
    source = i.sql(
        "select c_custkey, c_name, c_nationkey, cast(c_acctbal as decimal(18,2)) as c_acctbal, c_mktsegment "
        "from {customer}"
    )
    return scd.merge_new_columns(source.drop("c_mktsegment"), source)


@query(
    "join_on_keys",
    """select s.c_custkey, s.c_mktsegment as source_segment, t.c_mktsegment as target_segment
       from {scd_source} s join {open_target} t on lower(s.c_name) = lower(t.c_name) and s.c_custkey = t.c_custkey""",
)
def _(i: Inputs):
    joined = joins.join_on_keys(
        i.view("scd_source"), i.view("open_target"), ["c_custkey", "c_name"], case_insensitive=True
    )
    return joined.select(
        F.col("source.c_custkey"),
        F.col("source.c_mktsegment").alias("source_segment"),
        F.col("target.c_mktsegment").alias("target_segment"),
    )


@query("source_keys", "select c_custkey, c_nationkey from {scd_source} s")
def _(i: Inputs):
    return joins.source_keys(i.view("scd_source"), ["c_custkey", "c_nationkey"])


@query(
    "new_records",
    f"""select {COLUMNS} from {{scd_source}} s
        where not exists (select 1 from {{open_target}} t where t.c_custkey = s.c_custkey)""",
)
def _(i: Inputs):
    return joins.new_records(i.view("scd_source"), i.view("open_target"), KEYS)


@query(
    "missing_records",
    f"""select {COLUMNS} from {{open_target}} t
        where not exists (select 1 from {{scd_source}} s where t.c_custkey = s.c_custkey)""",
)
def _(i: Inputs):
    return joins.missing_records(i.view("scd_source"), i.view("open_target"), KEYS)


@query(
    "changed_records",
    f"""select {COLUMNS} from {{scd_source}} s
        where exists (select 1 from {{open_target}} t where t.c_custkey = s.c_custkey and {CHANGED})""",
)
def _(i: Inputs):
    return joins.changed_records(i.view("scd_source"), i.view("open_target"), KEYS)


@query(
    "semi_by_key",
    "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from {scd_source} s)",
)
def _(i: Inputs):
    orders = i.table("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return joins.semi_by_key(orders, i.view("scd_source"), KEYS).withColumnRenamed("c_custkey", "o_custkey")


@query(
    "insert_if_absent",
    """select c.processing_group_name, c.identifier
       from (select processing_group_name, case when job_id % 3 = 0 then null else identifier end as identifier
             from {job_ctl} a) c
       where not exists (
           select 1 from (select processing_group_name, status,
                                 case when job_id % 3 = 0 then null else identifier end as identifier
                          from {job_ctl} b) j
           where j.processing_group_name = c.processing_group_name and j.identifier is not distinct from c.identifier
             and j.status in ('READY', 'RUNNING'))""",
)
def _(i: Inputs):
    jobs = i.sql(
        "select processing_group_name, status, case when job_id % 3 = 0 then null else identifier end as identifier "
        "from {job_ctl}"
    )
    return joins.insert_if_absent(jobs, jobs.select("processing_group_name", "identifier"))


@query(
    "insert_select",
    f"""select {COLUMNS} from {{open_target}} t
        union all
        select c_custkey, to_base64(unhex(sha256(c_name))), c_nationkey, c_acctbal, 'JOB-7'
        from {{scd_source}} s where c_nationkey < 12""",
)
def _(i: Inputs):
    return maintenance.insert_select(
        i.view("open_target"),
        i.view("scd_source"),
        columns=["c_custkey", "c_name", "c_nationkey", "c_acctbal"],
        extra={"c_mktsegment": "JOB-7"},
        where="where c_nationkey < 12",
        encrypt=["C_NAME"],
    )


@query("delete_rows", f"select {COLUMNS} from {{open_target}} t where not coalesce(c_mktsegment = 'OLD', false)")
def _(i: Inputs):
    return maintenance.delete_rows(i.view("open_target"), "where c_mktsegment = 'OLD'")


@query(
    "update_rows",
    """select job_id, batch_id, case when status = 'READY' or status = 'RUNNING' then 'ERROR' else status end as status
       from {job_ctl} j""",
)
def _(i: Inputs):
    jobs = i.view("job_ctl").select("job_id", "batch_id", "status")
    return maintenance.update_rows(jobs, "status = 'READY' or status = 'RUNNING'", {"status": "ERROR"})


@query(
    "replace_scope",
    f"""select {COLUMNS} from {{open_target}} t
        where not exists (select 1 from {{scd_source}} s where s.c_nationkey = t.c_nationkey and s.c_nationkey < 5)
        union all select {COLUMNS} from {{scd_source}} s where c_nationkey < 5""",
)
def _(i: Inputs):
    rows = i.view("scd_source").where("c_nationkey < 5")
    return maintenance.replace_scope(i.view("open_target"), rows, rows, ["c_nationkey"])


@query(
    "scoped_snapshot",
    """select 'snapshot' as part, count(*) as n, sum(o_custkey) as total from orders
       where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')
       union all
       select 'remaining', count(*), sum(o_custkey) from orders
       where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')""",
)
def _(i: Inputs):
    scope = i.table("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    parts = maintenance.scoped_snapshot(i.table("orders").select("o_orderkey", "o_custkey"), scope, ["o_custkey"])
    totals = [
        part.agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total")).select(F.lit(name).alias("part"), "n", "total")
        for name, part in zip(("snapshot", "remaining"), parts)
    ]
    return totals[0].unionByName(totals[1])


@query(
    "cascade_delete",
    """with gone as (select batch_id from {batch_ctl} b where batch_id % 4 = 1),
            gone_jobs as (select job_id from {job_ctl} j where batch_id in (select batch_id from gone))
       select 'batch_ctl' as table_name, count(*) as n_rows from {batch_ctl} b where batch_id % 4 <> 1
       union all select 'job_ctl', count(*) from {job_ctl} j where batch_id not in (select batch_id from gone)
       union all select 'load_execution', count(*) from {load_execution} l
                 where job_id not in (select job_id from gone_jobs)""",
)
def _(i: Inputs):
    left = maintenance.cascade_delete(
        i.view("batch_ctl"),
        [
            ("job_ctl", i.view("job_ctl"), "job_id", "batch_id"),
            ("load_execution", i.view("load_execution"), "load_execution_id", "job_id"),
        ],
        "batch_id % 4 = 1",
    )
    names = {"parents": "batch_ctl", "job_ctl": "job_ctl", "load_execution": "load_execution"}
    counts = [
        frame.agg(F.count("*").alias("n_rows")).select(F.lit(names[name]).alias("table_name"), "n_rows")
        for name, frame in left.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "insert_records",
    """select c_custkey, c_name, c_nationkey from customer
       union all select c_custkey + 1000000000, c_name, cast(null as integer) from customer""",
)
def _(i: Inputs):
    target = i.table("customer").select("c_custkey", "c_name", "c_nationkey")
    records = target.select(
        F.to_json(F.struct((F.col("c_custkey") + 1000000000).alias("c_custkey"), "c_name")).alias("value")
    )
    return maintenance.insert_records(target, records)


LINE_KEYS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey", "l_partkey"]


@query(
    "distribute_by_keys",
    f"select {', '.join(LINE_KEYS)}, count(*) as n_lines from lineitem group by all",
)
def _(i: Inputs):
    """All five keys deal the rows out; the aggregate reuses the distribution: one shuffle, not two."""
    spread = maintenance.distribute_by_keys(i.table("lineitem").select(*LINE_KEYS), primary=LINE_KEYS)
    return spread.groupBy(*LINE_KEYS).agg(F.count("*").alias("n_lines"))


@query(
    "table_minus",
    """select o_custkey from orders except select c_custkey from {scd_source} s""",
)
def _(i: Inputs):
    return maintenance.table_minus(
        i.table("orders").select("o_custkey"), i.view("scd_source").select(F.col("c_custkey").alias("o_custkey"))
    )


@query(
    "table_minus_all",
    """select o_custkey from orders except all select c_custkey from customer""",
)
def _(i: Inputs):
    return maintenance.table_minus(
        i.table("orders").select("o_custkey"),
        i.table("customer").select(F.col("c_custkey").alias("o_custkey")),
        distinct=False,
    )


def _versions(changed: str) -> str:
    """Customers with columns in which versions differ by little; ``changed`` says which version it is."""
    return f"""
        select c_custkey,
               cast(1234567890123456789 as decimal(30,10)) + cast(case when {changed} and c_custkey % 9 = 0
                   then 0.0000000001 else 0 end as decimal(30,10)) as amount,
               case when c_custkey % 8 = 0 then case when {changed} then null else '' end else c_name end as name,
               case when {changed} and c_custkey % 6 = 0 then 'ab' else 'a' end as first_part,
               case when {changed} and c_custkey % 6 = 0 then 'c' else 'bc' end as second_part
        from {{customer}} where c_custkey % 11 <> case when {changed} then 1 else 2 end"""


@query(
    "reconcile_tables",
    f"""with a as ({_versions('1 = 0')}), b as ({_versions('1 = 1')})
        select coalesce(a.c_custkey, b.c_custkey) as c_custkey,
               case when b.c_custkey is null then 'only_source' when a.c_custkey is null then 'only_target'
                    else 'different' end as status
        from a full join b on a.c_custkey = b.c_custkey
        where a.c_custkey is null or b.c_custkey is null or a.amount <> b.amount
              or a.name is distinct from b.name or a.first_part <> b.first_part or a.second_part <> b.second_part""",
)
def _(i: Inputs):
    """Decimals that differ late, NULL against '', and parts that join to one text."""
    return reconcile.reconcile_tables(i.sql(_versions("1 = 0")), i.sql(_versions("1 = 1")), KEYS)


@query(
    "snapshot_diff",
    f"""select coalesce(s.c_custkey, t.c_custkey) as c_custkey,
               case when s.c_custkey is null then 'removed' when t.c_custkey is null then 'added' else 'changed' end
                   as status
        from {{open_target}} t full join {{scd_source}} s on s.c_custkey = t.c_custkey
        where s.c_custkey is null or t.c_custkey is null or {CHANGED}""",
)
def _(i: Inputs):
    return reconcile.snapshot_diff(i.view("open_target"), i.view("scd_source"), KEYS)
