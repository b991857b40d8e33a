"""Dense row numbers without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedwright.functions.text import quoted
from feedwright.registry import operator
from feedwright.staging import stage

# Row position inside a partition is the low 33 bits of Spark's monotonically increasing id, the partition the rest.
POSITION_BITS = 33


@operator("number_rows")
def number_rows(df: DataFrame, order: Sequence[str], name: str, start: Column | int = 0) -> DataFrame:
    """Number rows 1, 2, 3 … (+ ``start``) in the order of columns.

    Rows are range-partitioned by the order columns, with a row hash as tie-break so that one frequent value spreads
    over many tasks, sorted per partition and staged once. Offsets are running totals over one row per partition; only
    that tiny frame goes through a global window and only it is broadcast, so its size is bounded by the task count.
    Equal rows are interchangeable; rows equal only in the order columns are ordered by the hash.
    """
    tie = "_tie"
    hashed = df.withColumn(tie, F.xxhash64(*[quoted(column) for column in df.columns]))
    by = [quoted(column) for column in order] + [F.col(tie)]
    placed = stage(
        hashed.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_position", F.monotonically_increasing_id())
        .drop(tie),
        "numbered",
    )
    part = F.shiftright("_position", POSITION_BITS)
    within = F.col("_position").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    per_part = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    first = start if isinstance(start, Column) else F.lit(start)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + within + 1 + first).cast("bigint"))
        .drop("_part", "_position", "_offset")
    )


@operator("assign_surrogate_keys")
def assign_surrogate_keys(df: DataFrame, keys: Sequence[str], surrogate: str, max_sk: Column | int = 0) -> DataFrame:
    """New rows numbered on from the highest surrogate key, in business-key order."""
    numbered = number_rows(df, keys, surrogate, max_sk)
    return numbered.select(surrogate, *[quoted(name) for name in df.columns])
