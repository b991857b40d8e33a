"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0 .. N-1 in a fixed order; an alternating Feistel network permutes a grid of a x b >= N cells, and
cycle walking brings it back to exactly 0 .. N-1. Position p of a row is its place in the shuffled corpus: shard p mod S,
slot p div S. Shard sizes differ by one at most, and where a row goes can be computed from its number alone.

The grid has fewer than a cells too many, a being about the root of N, so a walk is short; the exact longest walk is
measured on those few cells. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedwright.llm.common import query, table
from feedwright.operators.numbering import number_rows
from feedwright.staging import stage

SHARDS = 8
ROUNDS = 4
KEY = "shuffle-1"


class Feistel:
    """Keyed permutation of 0 .. size-1 as column expressions."""

    def __init__(self, spark: SparkSession, size: int, key: str = KEY, rounds: int = ROUNDS):
        self.size, self.key, self.rounds = size, key, rounds
        self.left = max(1, math.isqrt(max(0, size - 1)) + 1)
        self.right = max(1, -(-size // self.left))
        self.walks = self._longest_walk(spark)

    def _mix(self, round_number: int, half: Column) -> Column:
        """48 bits that depend on the key, the round and the other half."""
        name = F.concat(F.lit(f"{self.key}/{round_number}/"), half.cast("string"))
        return F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("long")

    def _half_step(self, number: int, changed: str, other: str, cells: int):
        """Lambda that shifts one half by a function of the other."""

        def step(s: Column) -> Column:
            moved = ((s[changed] + self._mix(number, s[other])) % cells).alias(changed)
            return F.struct(moved, s["r"].alias("r")) if changed == "l" else F.struct(s["l"].alias("l"), moved)

        return step

    def once(self, at: Column) -> Column:
        """The permutation of the whole grid."""
        low = at % self.right
        state = F.struct(((at - low) / self.right).cast("long").alias("l"), low.alias("r"))
        # A one-element array binds the state of a step, so it is computed once.
        for number in range(self.rounds):
            state = F.transform(F.array(state), self._half_step(2 * number, "l", "r", self.left))[0]
            state = F.transform(F.array(state), self._half_step(2 * number + 1, "r", "l", self.right))[0]
        return F.transform(F.array(state), lambda s: s["l"] * self.right + s["r"])[0]

    def _longest_walk(self, spark: SparkSession) -> int:
        """Steps after which every row is inside: the longest chain of cells outside that leads inside, plus one.

        Each step shortens every such chain by one cell, so the cells still outside grow fewer until only cycles that
        lie outside as a whole are left, which no row enters.
        """
        outside = spark.range(self.size, self.left * self.right).select("id")
        steps, before, now = 0, None, self.left * self.right - self.size
        while now and now != before:
            outside = stage(outside.select(self.once(F.col("id")).alias("id")).where(F.col("id") >= self.size), "walk")
            steps, before, now = steps + 1, now, outside.count()
        return steps if now else steps + 1

    def permute(self, at: Column) -> Column:
        """Place of row number ``at`` (from 0) in the shuffled order."""
        place = self.once(at)
        for _ in range(self.walks - 1):
            place = F.transform(F.array(place), lambda p: F.when(p < self.size, p).otherwise(self.once(p)))[0]
        return place


def shard_rows(
    df: DataFrame, order: Sequence[str], shards: int = SHARDS, key: str = KEY, keep: Sequence[str] | None = None
) -> DataFrame:
    """``df`` (or the columns to ``keep``) with ``row_number`` (from 0 in the given order), ``shard`` and ``slot``.

    Columns of those names are replaced. NULLs sort first; rows equal in the order columns are told apart by a hash of
    all columns, and equal rows are interchangeable. An empty table gives no rows.
    """
    narrow = df.drop("row_number", "shard", "slot")
    narrow = narrow.select(*keep) if keep else narrow
    numbered = number_rows(narrow, order, "row_number", F.lit(-1))
    network = Feistel(df.sparkSession, numbered.count(), key)
    placed = numbered.withColumn("_place", network.permute(F.col("row_number")))
    return placed.select(
        *[f"`{name}`" for name in narrow.columns],
        "row_number",
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("long").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows of a file in slot order."""
    by = [F.col("shard"), F.col("slot")]
    sharded.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy("shard").parquet(path)


def _oracle_half(number: int, half: str) -> str:
    return f"cast('0x' || substr(md5('{KEY}/{number}/' || cast({half} as varchar)), 1, 12) as bigint)"


def _oracle() -> str:
    def step(source: str) -> str:
        text = f"select id, n, a, b, p // b as l, p % b as r from {source}"
        for number in range(ROUNDS):
            text = f"select id, n, a, b, (l + {_oracle_half(2 * number, 'r')}) % a as l, r from ({text})"
            text = f"select id, n, a, b, l, (r + {_oracle_half(2 * number + 1, 'l')}) % b as r from ({text})"
        return f"select id, n, a, b, l * b + r as p from ({text})"

    bit = "case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end"
    table_entry = f"list_reduce(list_prepend(x, range(8)), lambda c, _: {bit})"
    return f"""
with recursive docs as (
    select doc_id, strlen(coalesce(text, '')) + 1 as size, coalesce(text, '') as t,
           cast(row_number() over (order by doc_id nulls first, text) - 1 as bigint) as id,
           cast(count(*) over () as bigint) as n
    from documents),
crc as (select list_transform(range(256), lambda x: {table_entry}) as tab),
sums as (
    select id, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: cast('0x' || x as bigint))),
        lambda c, x: xor(c // 256, tab[xor(c, x) % 256 + 1]))) as text_crc32
    from docs, crc),
side as (select id, n, greatest(cast(ceil(sqrt(n)) as bigint), 1) as a from docs),
grid as (select id, n, a, cast(ceil(n / a) as bigint) as b, id as p from side),
walk as (
    {step('grid')}
    union all
    {step('(select * from walk where p >= n)')}),
placed as (select id, p from walk where p < n)
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'rows' as law,
       cast(p % {SHARDS} as int) as shard, p // {SHARDS} as slot, cast(null as int) as grown_shard
from docs join placed using (id) join sums using (id)
"""


@query("op3_feistel_sharding", _oracle())
def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of equal row counts."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    sharded = shard_rows(docs, ["doc_id"])
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
