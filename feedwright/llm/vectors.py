"""Searches of a stated set of vectors against all rows: shards of an index, each met by every block of searches.

Rows are dealt to shards by a hash of their id, so each shard is a bounded random part whatever ids, labels or vectors
repeat. A task builds the index of one shard from a stream sorted by shard and kind, then answers one packed block of
searches after the other; only the shard and a block are held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

LEAST_SHARDS = 8
SHARD_ROWS = 65_536
BLOCK_ROWS = 1024


def usable(vector: Column) -> Column:
    """True for a vector with components, none of them null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def shard_count(rows: int) -> int:
    return max(LEAST_SHARDS, -(-rows // SHARD_ROWS))


def matrix(values: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    rows = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(rows) % max(1, len(values)) or len({*np.diff(values.offsets.to_numpy())}) > 1:
        raise ValueError("vectors of different lengths")
    return rows.reshape(len(values), -1)


def blocks(searches: DataFrame, count: int, key: str) -> DataFrame:
    """(block, body): searches packed by a hash of their key as Arrow streams of about ``BLOCK_ROWS`` rows."""

    def pack(group: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, group.schema) as writer:
            writer.write_table(group)
        return pa.table({"block": group.column("_block").slice(0, 1), "body": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    number = F.pmod(F.xxhash64(key, F.lit("block")), F.lit(max(1, -(-count // BLOCK_ROWS)))).alias("_block")
    return searches.select(number, "*").groupBy("_block").applyInArrow(pack, "block long, body binary")


def unpacked_block(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all().combine_chunks()


def search_shards(
    rows: DataFrame,
    key: str,
    packed: DataFrame,
    shards: int,
    build: Callable[[pa.Table], object],
    answer: Callable[[object, pa.Table], pa.Table],
    schema: str | T.StructType,
) -> DataFrame:
    """``answer(build(rows of a shard), block)`` for every shard and every block of searches.

    A shard without rows answers nothing. What is sent is the rows once and the packed blocks once for each shard.
    """
    shard = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
    given = rows.select(shard.alias("_shard"), F.lit(0).alias("_kind"), F.lit(None).cast("binary").alias("_body"), F.struct("*").alias("_row"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard")
    nothing = F.lit(None).cast(given.schema["_row"].dataType).alias("_row")
    asked = packed.select(every, F.lit(1).alias("_kind"), F.col("body").alias("_body"), nothing)
    dealt = given.unionByName(asked).repartitionById(shards, F.col("_shard")).sortWithinPartitions("_shard", "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, index = None, [], None
        for batch in batches:
            kinds, homes = batch.column("_kind").to_numpy(), batch.column("_shard").to_numpy()
            bounds = np.flatnonzero(np.diff(homes * 2 + kinds)) + 1
            for low, high in zip([0, *bounds], [*bounds, batch.num_rows]):
                if high == low:
                    continue
                if homes[low] != current:
                    current, parts, index = homes[low], [], None
                piece = batch.slice(low, high - low)
                if kinds[low] == 0:
                    parts.append(pa.Table.from_batches([pa.RecordBatch.from_struct_array(piece.column("_row"))]))
                    continue
                if parts:
                    index, parts = build(pa.concat_tables(parts).combine_chunks()), []
                if index is not None:
                    for body in piece.column("_body"):
                        yield from answer(index, unpacked_block(body.as_py())).to_batches()

    return dealt.mapInArrow(run, schema)
