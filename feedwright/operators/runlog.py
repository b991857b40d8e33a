"""Run log: batches, jobs, steps and their texts."""

from __future__ import annotations

import datetime
import json
import socket
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from feedwright.functions.columns import qualified_target
from feedwright.registry import operator

COMPLETE = "COMPLETE"
COMPLETE_WITH_ERROR = "COMPLETE_WITH_ERROR"
ERROR = "ERROR"
READY = "READY"
RUNNING = "RUNNING"
TEXT_PART_SIZE = 60000

STEP_SCHEMA = (
    "load_execution_id string, job_id bigint, processing_group_name string, sequence_order int, target_db_name string, "
    "target_schema_name string, target_table_name string, start_ts timestamp, end_ts timestamp, processing_time bigint, "
    "execution_sts string, rows_affected bigint, hostname string, perf_stats string, step_notes string, "
    "template_name string, warnings string"
)


@operator("batch_jobs")
def batch_jobs(
    batches: DataFrame,
    jobs: DataFrame,
    ids: Sequence[int] | None = None,
    days: int | None = None,
    now: Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Batches with their jobs (batches without jobs included), by ids or by age.

    With ``limit`` the latest rows only, by batch and job id.
    """
    chosen = batches
    if ids is not None:
        chosen = chosen.where(F.col("batch_id").isin(*ids))
    elif days is not None:
        moment = now if now is not None else F.current_timestamp()
        chosen = chosen.where(F.col("start_ts") >= moment - F.make_interval(days=F.lit(days)))
    left = chosen.select(
        "batch_id",
        "batch_identifier",
        F.col("start_ts").alias("batch_start_ts"),
        F.col("end_ts").alias("batch_end_ts"),
        F.col("status").alias("batch_status"),
        F.col("processing_time").alias("batch_processing_time"),
    )
    right = jobs.select(
        "batch_id",
        "job_id",
        F.col("identifier").alias("job_identifier"),
        F.col("start_ts").alias("job_start_ts"),
        F.col("end_ts").alias("job_end_ts"),
        F.col("status").alias("job_status"),
        F.col("processing_time").alias("job_processing_time"),
    )
    joined = left.join(right, "batch_id", "left")
    return joined.orderBy(F.desc("batch_id"), F.desc("job_id")).limit(limit) if limit is not None else joined


@operator("batch_status")
def batch_status(batches: DataFrame, jobs: DataFrame) -> DataFrame:
    """Final status per batch: with error when any job is not complete. Jobs are counted before the join."""
    errors = jobs.groupBy("batch_id").agg(F.count_if(F.col("status") != COMPLETE).alias("error_number"))
    return batches.select("batch_id").join(errors, "batch_id", "left").select(
        "batch_id",
        F.coalesce("error_number", F.lit(0)).alias("error_number"),
        F.when(F.col("error_number") > 0, COMPLETE_WITH_ERROR).otherwise(COMPLETE).alias("status"),
    )


@operator("max_runtime")
def max_runtime(batches: DataFrame) -> DataFrame:
    """Longest processing time per batch identifier."""
    return batches.groupBy("batch_identifier").agg(F.max("processing_time").alias("max_runtime"))


@operator("runtime_progress")
def runtime_progress(running: DataFrame, batches: DataFrame) -> DataFrame:
    """Percent of the longest known run for running work with (batch_identifier, seconds)."""
    longest = max_runtime(batches)
    divisor = F.coalesce(F.nullif(F.col("max_runtime"), F.lit(0)), F.lit(1))
    return running.join(longest, "batch_identifier", "left").withColumn(
        "progress", (F.col("seconds") / divisor * 100).cast("decimal(18,3)")
    )


@operator("group_steps")
def group_steps(config: DataFrame, groups: DataFrame) -> DataFrame:
    """Number of steps per processing group. Steps are counted before the join."""
    counted = config.groupBy("processing_group_name").agg(F.count("sequence_order").alias("template_steps"))
    return groups.select("processing_group_name", "disable_flag").join(counted, "processing_group_name")


@operator("job_steps")
def job_steps(steps: DataFrame, job_id: int | None = None, ordered: bool = True) -> DataFrame:
    """Steps of a job with their dotted target name, in order."""
    chosen = steps.where(F.col("job_id") == job_id) if job_id is not None else steps
    shown = chosen.select(
        "job_id",
        "sequence_order",
        "load_execution_id",
        "warnings",
        "template_name",
        qualified_target(
            F.col("target_db_name"), F.col("target_schema_name"), F.col("target_table_name")
        ).alias("target"),
        "processing_time",
        "rows_affected",
        "perf_stats",
    )
    return shown.orderBy("job_id", "sequence_order") if ordered else shown


@operator("last_value")
def last_value(df: DataFrame, column: str, name: str = "last_value") -> DataFrame:
    """Scalar maximum of a column as one row."""
    return df.agg(F.max(column).alias(name))


@operator("log_types")
def log_types(parts: DataFrame, exclude: Sequence[str] = ("log", "error")) -> DataFrame:
    """Distinct custom log types per step."""
    return parts.where(~F.col("log_type").isin(*exclude)).select("load_execution_id", "log_type").distinct()


@operator("split_text_parts")
def split_text_parts(df: DataFrame, column: str = "text", size: int = TEXT_PART_SIZE) -> DataFrame:
    """Long texts as numbered parts. A text whose length is a multiple of the size ends with an empty part."""
    count = F.floor(F.length(column) / F.lit(size)).cast("int") + 1
    others = [F.col(f"`{name}`") for name in df.columns if name != column]
    return df.where(F.col(column).isNotNull()).select(
        *others, F.explode(F.sequence(F.lit(1), count)).alias("part_sequence"), F.col(column).alias("_text")
    ).select(
        *others,
        "part_sequence",
        F.substring("_text", (F.col("part_sequence") - 1) * size + 1, F.lit(size)).alias("part_text"),
    )


@operator("reassemble_text")
def reassemble_text(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Parts back to whole texts in part order; a group is one text, so it is as large as one cell."""
    ordered = F.array_sort(F.collect_list(F.struct("part_sequence", "part_text")))
    return parts.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda p: p["part_text"]), "").alias("text"))


@operator("affected_rows")
def affected_rows(df: DataFrame, name: str = "affected") -> tuple[DataFrame, Observation]:
    """The frame with a row counter: after the action, ``observation.get['rows_affected']`` is the count."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows_affected")), observation


@operator("step_audit")
@contextmanager
def step_audit(
    spark: SparkSession,
    log_path: str,
    job_id: int,
    group: str,
    sequence_order: int,
    template: str,
    target: tuple[str, str, str] = ("", "", ""),
    notes: str | None = None,
):
    """Log one step as an appended row: start, end, seconds, rows affected, notes, statistics, warnings.

    The block gets a dict and may set ``rows_affected``, ``perf_stats`` (a dict) and ``warnings`` (a list). A failing
    block is logged with status ERROR and raises on.
    """
    import uuid

    facts: dict = {"rows_affected": None, "perf_stats": {}, "warnings": []}
    start = datetime.datetime.now(datetime.timezone.utc)
    status = COMPLETE
    try:
        yield facts
    except Exception:
        status = ERROR
        raise
    finally:
        end = datetime.datetime.now(datetime.timezone.utc)
        row = (
            uuid.uuid4().hex,
            job_id,
            group,
            sequence_order,
            *target,
            start,
            end,
            int((end - start).total_seconds()),
            status,
            facts["rows_affected"],
            socket.gethostname(),
            json.dumps(facts["perf_stats"]),
            notes,
            template,
            json.dumps(facts["warnings"]),
        )
        spark.createDataFrame([row], STEP_SCHEMA).coalesce(1).write.mode("append").parquet(log_path)
