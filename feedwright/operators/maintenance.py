"""Copy-on-write table maintenance: every operator gives the new table as a frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from feedwright.functions.columns import optional_filter, stamp_columns
from feedwright.functions.text import encrypt_columns, quoted
from feedwright.operators.joins import semi_by_key
from feedwright.registry import operator
from feedwright.sources.delimited import write_csv
from feedwright.staging import stage

ROWS_PER_PARTITION = 1_000_000


@operator("insert_select")
def insert_select(
    target: DataFrame,
    source: DataFrame,
    columns: Mapping[str, str] | Sequence[str] | None = None,
    extra: Mapping[str, Column | object] | None = None,
    where: str | None = None,
    encrypt: Sequence[str] = (),
) -> DataFrame:
    """Target plus selected source rows. Columns the target has and the insert lacks are NULL.

    ``columns`` is a list, or a map of target column to source expression text. Values take the target's types.
    """
    rows = optional_filter(source, where)
    if encrypt:
        rows = encrypt_columns(rows, encrypt)
    if isinstance(columns, Mapping):
        rows = rows.select(*[F.expr(text).alias(name) for name, text in columns.items()])
    elif columns is not None:
        rows = rows.select(*[quoted(name) for name in columns])
    if extra:
        rows = stamp_columns(rows, extra)
    types = {field.name: field.dataType for field in target.schema.fields}
    unknown = [name for name in rows.columns if name not in types]
    if unknown:
        raise ValueError(f"columns not in the target: {unknown}")
    typed = rows.select(*[quoted(name).cast(types[name]).alias(name) for name in rows.columns])
    return target.unionByName(typed, allowMissingColumns=True)


@operator("delete_rows")
def delete_rows(df: DataFrame, where: str | None = None) -> DataFrame:
    """Rows left after a delete; a predicate that is NULL deletes nothing, no predicate deletes everything."""
    if not where or not where.strip():
        return df.where(F.lit(False))
    text = where.strip()
    if text.lower().startswith("where"):
        text = text[5:]
    return df.where(~F.coalesce(F.expr(text), F.lit(False)))


@operator("update_rows")
def update_rows(df: DataFrame, where: str, values: Mapping[str, Column | object]) -> DataFrame:
    """Set columns where a predicate holds."""
    hit = F.coalesce(F.expr(where), F.lit(False))
    new = {name: value if isinstance(value, Column) else F.lit(value) for name, value in values.items()}
    return df.select(
        *[
            F.when(hit, new[field.name].cast(field.dataType)).otherwise(quoted(field.name)).alias(field.name)
            if field.name in new
            else quoted(field.name)
            for field in df.schema.fields
        ]
    )


@operator("replace_scope")
def replace_scope(target: DataFrame, rows: DataFrame, scope: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete the target rows whose key is in ``scope``, then insert ``rows``."""
    kept = target.join(scope.select(*[quoted(key) for key in keys]).distinct(), list(keys), "left_anti")
    return kept.select(*[quoted(name) for name in target.columns]).unionByName(rows)


@operator("scoped_snapshot")
def scoped_snapshot(
    df: DataFrame, scope: DataFrame, keys: Sequence[str], path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows of a list of composite keys (written as CSV when a path is given) and the table after their deletion."""
    snapshot = semi_by_key(df, scope, keys)
    if path is not None:
        write_csv(snapshot, path, upper_headers=False)
    remaining = df.join(scope.select(*[quoted(key) for key in keys]).distinct(), list(keys), "left_anti")
    return snapshot, remaining.select(*[quoted(name) for name in df.columns])


def partitions_for(df: DataFrame, least: int | None = None) -> int:
    """Number of partitions to deal ``df`` out to: one per ``ROWS_PER_PARTITION`` rows, ``least`` or one per core at least.

    Left to Spark, partitions are merged up to a size in bytes as shuffled, and as those are compressed, narrow or equal rows
    meet in a few tasks. The rows are counted first, for which a Parquet table's footers are enough.
    """
    least = df.sparkSession.sparkContext.defaultParallelism if least is None else least
    return max(least, -(-df.count() // ROWS_PER_PARTITION))


@operator("distribute_by_keys")
def distribute_by_keys(
    df: DataFrame,
    declared: Sequence[str] = (),
    primary: Sequence[str] = (),
    unique: Sequence[Sequence[str]] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Hash-distribute by all of the declared keys, else of the primary key, else of the first unique key.

    Without ``partitions`` their number follows the rows, see :func:`partitions_for`.
    """
    chosen = list(declared) or list(primary) or (list(unique[0]) if unique else [])
    columns = [quoted(name) for name in chosen]
    if not columns:
        return df
    return df.repartition(partitions or partitions_for(df), *columns)


@operator("write_distributed")
def write_distributed(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> None:
    """Save a table bucketed by its distribution keys, so later joins on them need no shuffle."""
    chosen = list(keys)
    # Dealt out by bucket first: one file per bucket rather than one per bucket and task.
    df.repartition(buckets, *[quoted(name) for name in chosen]).write.bucketBy(buckets, chosen[0], *chosen[1:]).sortBy(*chosen).saveAsTable(table)


@operator("cascade_delete")
def cascade_delete(
    parents: DataFrame, levels: Sequence[tuple[str, DataFrame, str, str]], where: str
) -> dict[str, DataFrame]:
    """Delete parents by a predicate and everything below them.

    ``levels`` goes from the top down: (name, frame, own key, parent's key column in the frame). Only key columns of
    the deleted rows travel down the chain, staged level by level, so no level computes those above it again. Returns the
    tables after the delete, the parents under ``parents``.
    """
    hit = F.coalesce(F.expr(where), F.lit(False))
    result = {"parents": parents.where(~hit)}
    doomed, key = parents.where(hit), None
    for name, frame, own_key, parent_key in levels:
        gone = stage(doomed.select(quoted(key or parent_key).alias("_gone")).distinct(), "gone")
        result[name] = frame.join(gone, quoted(parent_key) == F.col("_gone"), "left_anti")
        doomed = frame.join(gone, quoted(parent_key) == F.col("_gone"), "left_semi")
        key = own_key
    return result


@operator("insert_records")
def insert_records(target: DataFrame, records: DataFrame, column: str = "value") -> DataFrame:
    """JSON records, one object per row of a text column, inserted by key name; absent keys are NULL."""
    parsed = records.select(F.from_json(quoted(column), T.StructType(target.schema.fields)).alias("r")).select("r.*")
    return target.unionByName(parsed, allowMissingColumns=True)


@operator("table_minus")
def table_minus(left: DataFrame, right: DataFrame, distinct: bool = True) -> DataFrame:
    """Set difference; with ``distinct=False`` multiplicities count."""
    return left.subtract(right) if distinct else left.exceptAll(right)
