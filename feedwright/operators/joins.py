"""Join shapes on business keys."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from feedwright.functions.logic import all_of, any_of
from feedwright.functions.text import quoted
from feedwright.registry import operator

SOURCE = "source"
TARGET = "target"
TEXT_TYPES = (T.StringType, T.VarcharType, T.CharType)


def text_columns(df: DataFrame) -> set[str]:
    """Names of the string columns."""
    return {field.name for field in df.schema.fields if isinstance(field.dataType, TEXT_TYPES)}


def key_condition(target: DataFrame, keys: Sequence[str], case_insensitive: bool = False) -> Column:
    """Equality on every key between frames aliased source and target; string keys optionally in lower case."""
    folded = text_columns(target) if case_insensitive else set()

    def equal(key: str) -> Column:
        left, right = F.col(f"{SOURCE}.`{key}`"), F.col(f"{TARGET}.`{key}`")
        return F.lower(left) == F.lower(right) if key in folded else left == right

    return all_of(equal(key) for key in keys)


@operator("join_on_keys")
def join_on_keys(
    source: DataFrame, target: DataFrame, keys: Sequence[str], how: str = "inner", case_insensitive: bool = False
) -> DataFrame:
    """Equi-join on a key list. Both sides keep their columns, addressed as ``source.x`` and ``target.x``."""
    return source.alias(SOURCE).join(
        target.alias(TARGET), key_condition(target, keys, case_insensitive), how
    )


@operator("source_keys")
def source_keys(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key projection of the source."""
    return source.select(*[quoted(key) for key in keys])


@operator("new_records")
def new_records(
    source: DataFrame, target: DataFrame, keys: Sequence[str], case_insensitive: bool = False
) -> DataFrame:
    """Source rows whose key is not in the target. A NULL key equals nothing, so such rows are always new."""
    return join_on_keys(source, source_keys(target, keys), keys, "left_anti", case_insensitive)


@operator("missing_records")
def missing_records(
    source: DataFrame, target: DataFrame, keys: Sequence[str], case_insensitive: bool = False
) -> DataFrame:
    """Target rows whose key is not in the source."""
    condition = key_condition(target, keys, case_insensitive)
    return target.alias(TARGET).join(source_keys(source, keys).alias(SOURCE), condition, "left_anti")


@operator("semi_by_key")
def semi_by_key(
    df: DataFrame, key_list: DataFrame, keys: Sequence[str], case_insensitive: bool = False
) -> DataFrame:
    """Rows whose key is in a key list."""
    return join_on_keys(df, source_keys(key_list, keys), keys, "left_semi", case_insensitive)


def compared_columns(source: DataFrame, target: DataFrame, ignore: Iterable[str]) -> list[str]:
    """Target columns compared for a change: all but the ignored ones. Each must exist in the source."""
    dropped = {name.strip().lower() for name in ignore}
    chosen = [name for name in target.columns if name.lower() not in dropped]
    absent = [name for name in chosen if name not in source.columns]
    if absent:
        raise ValueError(f"compared columns are not in the source: {absent}; list them in ignore")
    return chosen


def attribute_changed(
    source: DataFrame, target: DataFrame, ignore: Iterable[str] = (), case_insensitive: bool = False
) -> Column:
    """NULL-safe "any compared column differs"; false when nothing is compared."""
    folded = text_columns(target) if case_insensitive else set()

    def differs(name: str) -> Column:
        left, right = F.col(f"{SOURCE}.`{name}`"), F.col(f"{TARGET}.`{name}`")
        if name in folded:
            left, right = F.lower(left), F.lower(right)
        return ~left.eqNullSafe(right)

    return any_of(differs(name) for name in compared_columns(source, target, ignore))


@operator("changed_records")
def changed_records(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    ignore: Iterable[str] = (),
    case_insensitive: bool = False,
) -> DataFrame:
    """Source rows for which a target row of the same key differs in a compared column.

    The target is folded to one row per key, the least and the greatest digest of its compared columns: a source row has a
    target row that differs exactly when either is not its own. So repeated keys are never paired, and adaptive execution
    can split a hot source key. A key with a NULL part equals nothing; without compared columns nothing changes.
    """
    columns = compared_columns(source, target, ignore)
    if not columns:
        return source.limit(0)
    folded = text_columns(target) if case_insensitive else set()

    def key(name: str) -> Column:
        return F.lower(quoted(name)) if name in folded else quoted(name)

    def laid_out(df: DataFrame, *more: Column) -> DataFrame:
        # Both sides under the target's types, so that equal values have equal digests.
        cells = [(F.lower(quoted(name)) if name in folded else quoted(name)).cast(target.schema[name].dataType).alias(f"_c{k}") for k, name in enumerate(columns)]
        return df.select(*more, *[key(name).alias(f"_k{k}") for k, name in enumerate(keys)], *cells)

    names = [f"_k{k}" for k in range(len(keys))]
    present = all_of(F.col(name).isNotNull() for name in names)
    given = laid_out(target).where(present)
    cells = [F.col(f"_c{k}") for k in range(len(columns))]
    # The hash skips NULLs, so where they stand is hashed as well, whatever either side's schema says of them.
    digest = F.struct(*[F.xxhash64(F.lit(seed), *cells, *[cell.isNull() for cell in cells]) for seed in (1, 2)])
    ends = given.groupBy(*names).agg(F.min(digest).alias("_least"), F.max(digest).alias("_most"))
    asked = laid_out(source, F.struct(*[quoted(name) for name in source.columns]).alias("_row"))
    met = asked.withColumn("_own", digest).join(ends, names).where((F.col("_own") != F.col("_least")) | (F.col("_own") != F.col("_most")))
    return met.select(*[F.col("_row").getField(name).alias(name) for name in source.columns])


@operator("assert_unique_keys")
def assert_unique_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise when a key occurs twice; returns the frame. Counts combine map-side and stop at the first duplicate."""
    twice = df.groupBy(*[quoted(key) for key in keys]).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate key {tuple(twice[0])[:-1]} occurs {twice[0]['n']} times")
    return df


@operator("insert_if_absent")
def insert_if_absent(
    existing: DataFrame,
    candidates: DataFrame,
    group: str = "processing_group_name",
    identifier: str = "identifier",
    status: str = "status",
    in_flight: Sequence[str] = ("READY", "RUNNING"),
) -> DataFrame:
    """Candidates without an in-flight row of the same group and identifier (NULL equals NULL)."""
    busy = existing.where(F.col(status).isin(*in_flight)).select(group, identifier).distinct()
    condition = (F.col(f"c.{group}") == F.col(f"b.{group}")) & F.col(f"c.{identifier}").eqNullSafe(
        F.col(f"b.{identifier}")
    )
    return candidates.alias("c").join(busy.alias("b"), condition, "left_anti")
