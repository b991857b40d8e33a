"""Helpers shared by the operators: tables, row payloads, byte chunks, registration of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Text that one Python task holds decoded at a time; a single longer text is held alone.
CHUNK_BYTES = 4 << 20


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` with the SQL that must give the same rows, if there is one."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, *needed: str, keep: Sequence[str] | None = None) -> DataFrame:
    """The columns to ``keep`` (default all) as one struct ``row``, and the ``needed`` ones as ``in_<name>``.

    In this form no column that an operator adds can clash with one of the table.
    """
    columns = [F.col(f"`{name}`") for name in (df.columns if keep is None else keep)]
    return df.select(F.struct(*columns).alias("row"), *[F.col(f"`{name}`").alias(f"in_{name}") for name in needed])


def unpacked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of a struct ``row`` again."""
    return df.select(*[F.col("row").getField(name).alias(name) for name in columns])


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each, or one row."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and total + size > limit:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def lower_words_sql(text: str, word: str, dialect: str) -> str:
    """SQL text for the words of a column with A-Z lower-cased, for ``spark`` or ``duckdb``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = f"r'{word}'" if dialect == "spark" else f"'{word}'"
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{lower}'), {pattern}, 0)"
