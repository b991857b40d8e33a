"""Type mapping between databases, and Spark schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from feedwright.functions.text import quoted
from feedwright.registry import operator

# Digits below which a scale-free NUMBER fits the integer type.
NUMBER_WIDTHS = ((3, T.ByteType()), (5, T.ShortType()), (10, T.IntegerType()))
LONG_NVARCHAR = 16383
LONG_VARBINARY = 50

# Type name in a headings map and its Spark type; anything else is text.
HEADING_TYPES = {
    "INTEGER": T.LongType(),
    "NUMERIC": T.DecimalType(38, 9),
    "STRING": T.StringType(),
    "DATE": T.DateType(),
}


@operator("number_to_type")
def number_to_type(precision: int | None, scale: int | None = None) -> T.DataType:
    """NUMBER(p,s): without a scale the narrowest integer by digits, otherwise a decimal."""
    if precision is None:
        return T.DecimalType(38, 9)
    if scale:
        return T.DecimalType(precision, scale)
    for limit, data_type in NUMBER_WIDTHS:
        if precision < limit:
            return data_type
    return T.LongType()


@operator("nvarchar_to_type")
def nvarchar_to_type(length: int) -> T.DataType:
    """Long NVARCHAR becomes unbounded text."""
    return T.StringType() if length > LONG_NVARCHAR else T.VarcharType(length)


@operator("varbinary_to_type")
def varbinary_to_type(length: int) -> tuple[str, T.DataType]:
    """Long VARBINARY is stored as a blob. Spark has one binary type, so the storage class is returned beside it."""
    return ("blob" if length > LONG_VARBINARY else "varbinary", T.BinaryType())


@operator("conform_types")
def conform_types(df: DataFrame, mapping: Mapping[str, T.DataType | str]) -> DataFrame:
    """Cast columns to the target type of their source type.

    ``mapping`` goes from a Spark type text (``decimal(10,0)``, ``string`` …) or ``{NUMBER}`` for every decimal, which
    applies :func:`number_to_type`. Values that do not fit become NULL.
    """
    chosen = []
    for field in df.schema.fields:
        source = field.dataType.simpleString()
        target: T.DataType | str | None = mapping.get(source)
        if target is None and isinstance(field.dataType, T.DecimalType) and "{NUMBER}" in mapping:
            target = number_to_type(field.dataType.precision, field.dataType.scale)
        if target is None:
            chosen.append(quoted(field.name))
        else:
            name = target if isinstance(target, str) else target.simpleString()
            chosen.append(quoted(field.name).try_cast(name).alias(field.name))
    return df.select(*chosen)


@operator("conform_by_table")
def conform_by_table(df: DataFrame, mappings: DataFrame, source_db: str, target_db: str) -> DataFrame:
    """As :func:`conform_types`, with the mapping read from a type-mapping table.

    ``mappings`` has (source_db_type, source_column_type, target_db_type, target_column_type). It is bounded by the
    number of type names of one pair of databases.
    """
    rows = (
        mappings.where((F.col("source_db_type") == source_db) & (F.col("target_db_type") == target_db))
        .select("source_column_type", "target_column_type")
        .distinct()
        .collect()
    )
    return conform_types(df, {row[0]: row[1] for row in rows})


@operator("schema_from_headings")
def schema_from_headings(headings: Sequence[str], type_map: Mapping[str, str] | None = None) -> T.StructType:
    """Column names plus a ``{column: type}`` map give a schema; an unmapped column is text."""
    wanted = type_map or {}
    return T.StructType(
        [
            T.StructField(name, HEADING_TYPES.get(wanted.get(name, "STRING").upper(), T.StringType()), True)
            for name in headings
        ]
    )
