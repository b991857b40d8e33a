"""Comparing two versions of a table.

Both sides are first folded to one line per range of key hashes: its rows and sums of two hashes of key and row. Ranges
with equal lines are equal; only rows of the others are shuffled, so what moves follows the differences and not the
tables. Those rows are reduced to (key, digest) and counted per pair, then per key. The counts combine map-side, so
duplicate or hot keys are never paired, and the result is exact for duplicates: the multisets of a key's rows are compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from feedwright.functions.text import HASH_COLUMN, quoted, row_digest, row_hash
from feedwright.registry import operator


def _compare(
    left: DataFrame, right: DataFrame, keys: Sequence[str], digests: Sequence[str], names: Sequence[str]
) -> DataFrame:
    columns = [*map(quoted, keys), *map(quoted, digests)]
    sides = left.select(*columns, F.lit(True).alias("_left")).unionByName(right.select(*columns, F.lit(False).alias("_left")))
    return _compare_tagged(unequal_ranges(sides, "_left", keys, digests), "_left", keys, digests, names)


RANGES = 1 << 16


def unequal_ranges(sides: DataFrame, side: str, keys: Sequence[str], digests: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """Rows of the ranges of key hashes in which the two sides, told apart by a boolean column, are not the same multiset.

    A range is folded on both sides to counts and sums of the halves of two 64-bit hashes of its rows, with map-side
    combine: ``ranges`` lines per task at most, whatever the tables hold. The list of unequal ranges is at most as long,
    so it is broadcast.
    """
    place = F.pmod(F.xxhash64(*map(quoted, keys)), F.lit(ranges)).cast("int")
    whole = [*map(quoted, keys), *map(quoted, digests)]
    hashes = F.xxhash64(*whole), F.xxhash64(F.lit("second"), *whole)
    sign = F.when(quoted(side), 1).otherwise(-1)
    halves = [half for h in hashes for half in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    # 32-bit halves: sums of up to 2^31 rows of a range fit.
    folded = sides.groupBy(place.alias("_range")).agg(F.sum(sign).alias("_n"), *[F.sum(sign * half).alias(f"_s{k}") for k, half in enumerate(halves)])
    differs = F.col("_n") != 0
    for k in range(len(halves)):
        differs = differs | (F.col(f"_s{k}") != 0)
    unequal = folded.where(differs).select("_range")
    return sides.withColumn("_range", place).join(F.broadcast(unequal), "_range", "left_semi").drop("_range")


def _compare_tagged(
    sides: DataFrame, side: str, keys: Sequence[str], digests: Sequence[str], names: Sequence[str]
) -> DataFrame:
    only_left, only_right, different = names
    key_columns = [quoted(key) for key in keys]
    versions = sides.groupBy(*key_columns, *[quoted(name) for name in digests]).agg(
        F.count_if(F.col(side)).alias("_l"), F.count_if(~F.col(side)).alias("_r")
    )
    per_key = versions.groupBy(*key_columns).agg(
        F.sum("_l").alias("_l"),
        F.sum("_r").alias("_r"),
        F.max((F.col("_l") != F.col("_r")).cast("int")).alias("_differs"),
    )
    status = (
        F.when(F.col("_r") == 0, only_left).when(F.col("_l") == 0, only_right).when(F.col("_differs") == 1, different)
    )
    return per_key.select(*key_columns, status.alias("status")).where(F.col("status").isNotNull())


@operator("reconcile_tables")
def reconcile_tables(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
    by_hash: bool = False,
) -> DataFrame:
    """Keys whose rows differ or that exist on one side: only_source, only_target, different.

    Rows are compared column by column, NULL told apart from every value. ``by_hash`` compares :func:`row_hash` instead,
    for tables whose hashes are all that can be had: it cannot tell NULL from '' nor ('ab', 'c') from ('a', 'bc').
    """
    if columns is None:
        columns = [name for name in source.columns if name in target.columns and name not in set(keys)]
    if not by_hash:
        return _diff(source, target, keys, columns, ("only_source", "only_target", "different"))
    return _compare(
        row_hash(source, keys, columns),
        row_hash(target, keys, columns),
        keys,
        [HASH_COLUMN],
        ("only_source", "only_target", "different"),
    )


@operator("snapshot_diff")
def snapshot_diff(
    base: DataFrame, release: DataFrame, keys: Sequence[str], ignore: Iterable[str] = ()
) -> DataFrame:
    """Keys added, removed or changed from one version of a table to the next; NULL-aware."""
    dropped = set(ignore) | set(keys)
    columns = [name for name in base.columns if name not in dropped]
    return _diff(base, release, keys, columns, ("removed", "added", "changed"))


def _diff(
    base: DataFrame, release: DataFrame, keys: Sequence[str], columns: Sequence[str], names: Sequence[str]
) -> DataFrame:
    # Digests of one union, so both sides are hashed under the same types.
    sides = base.select(*[quoted(name) for name in [*keys, *columns]]).withColumn("_base", F.lit(True)).unionByName(
        release.select(*[quoted(name) for name in [*keys, *columns]]).withColumn("_base", F.lit(False))
    )
    digests = row_digest(sides, columns)
    narrow = sides.select(*[quoted(key) for key in keys], "_base", digests[0].alias("_d1"), digests[1].alias("_d2"))
    return _compare_tagged(unequal_ranges(narrow, "_base", keys, ["_d1", "_d2"]), "_base", keys, ["_d1", "_d2"], names)
