"""Bulk load of files into tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from feedwright.functions.dates import DATE_STYLES, ampm_to_timestamp
from feedwright.functions.logic import any_of
from feedwright.functions.text import quoted
from feedwright.registry import operator
from feedwright.sources.delimited import (
    CORRUPT_COLUMN,
    NULL_TEXT,
    option_character,
    read_delimited,
    skip_leading_rows,
    text_schema,
)
from feedwright.staging import stage

# Dialects of bulk load as presets of one operator.
LOAD_PRESETS = {
    "warehouse_csv": {"fmt": "csv", "quoted_newlines": True},
    "warehouse_json": {"fmt": "json"},
    "postgres_9": {"fmt": "csv", "header": True, "escape": '"', "null_value": ""},
    "postgres_8": {"fmt": "csv", "header": True, "escape": '"', "null_value": ""},
    "greenplum": {"fmt": "csv", "escape": '"', "null_value": ""},
    "redshift": {"fmt": "csv", "escape": '"', "null_value": NULL_TEXT},
    "hive": {"fmt": "csv", "sep": "\\001", "quote": None, "escape": None, "null_value": NULL_TEXT},
    "mysql": {"fmt": "csv", "sep": "\\t", "escape": "\\", "null_value": NULL_TEXT},
    "bcp": {"fmt": "csv", "sep": "\\t", "quote": None, "escape": None},
    "copy_into": {"fmt": "csv", "header": True},
}


def date_format(style: str | None, delimiter: str = "-") -> str | None:
    """Reader pattern of a date style."""
    return DATE_STYLES[style].replace("-", delimiter) if style else None


def typed_columns(
    schema: T.StructType, date_style: str | None = None, delimiter: str = "-", loose: bool = False
) -> list[Column]:
    """Expressions from string columns to the declared types, by name; a cell that does not fit becomes NULL.

    ``loose`` reads every date and time that validation by shape lets through: either delimiter, AM and PM, fractions
    of a second; without a style, year, month, day.
    """
    pattern = date_format(date_style, delimiter)

    def typed(field: T.StructField) -> Column:
        column = quoted(field.name)
        if loose and isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return ampm_to_timestamp(column, date_style or "YMD").cast(field.dataType)
        if pattern and isinstance(field.dataType, T.DateType):
            return F.try_to_date(column, pattern)
        if pattern and isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            times = (" H:mm:ss", " H:mm", "")
            parsed = F.coalesce(*[F.try_to_timestamp(column, F.lit(pattern + time)) for time in times])
            return parsed.cast(field.dataType)
        if isinstance(field.dataType, (T.VarcharType, T.CharType)):
            # A text too long for the column does not fit either.
            return F.when(F.length(F.rtrim(column)) <= field.dataType.length, column)
        if isinstance(field.dataType, T.StringType):
            return column
        return column.try_cast(field.dataType.simpleString())

    return [typed(field).alias(field.name) for field in schema.fields]


@operator("cast_rows")
def cast_rows(
    df: DataFrame, schema: T.StructType, date_style: str | None = None, delimiter: str = "-", loose: bool = False
) -> DataFrame:
    """All-string rows as rows of the declared types."""
    return df.select(*typed_columns(schema, date_style, delimiter, loose))


def _wrong_width(n_columns: int, sep: str, quote: str | None, jagged: bool, ignore_unknown: bool) -> Column:
    if jagged and ignore_unknown:
        return F.lit(False)
    record = quoted(CORRUPT_COLUMN)
    sign = re.escape(quote) if quote else None
    unquoted = F.regexp_replace(record, f"{sign}(?:[^{sign}]|{sign}{sign})*{sign}", "") if quote else record
    width = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep), F.lit(""))) + 1
    refused = F.lit(False)
    if not jagged:
        refused = refused | (width < n_columns)
    if not ignore_unknown:
        refused = refused | (width > n_columns)
    return record.isNotNull() & refused


def _parse_json(spark: SparkSession, path: str, names: Sequence[str], ignore_unknown: bool) -> DataFrame:
    record = F.from_json(
        "value",
        text_schema(names, corrupt=True),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COLUMN},
    )
    surplus = F.size(F.array_except(F.json_object_keys("value"), F.array(*[F.lit(name) for name in names]))) > 0
    unknown = F.lit(False) if ignore_unknown else F.coalesce(surplus, F.lit(False))
    return (
        spark.read.text(path)
        .select(record.alias("_row"), unknown.alias("_unknown"), F.col("value").alias("_text"))
        .select("_row.*", (F.col("_unknown") | F.col(f"_row.{CORRUPT_COLUMN}").isNotNull()).alias("_wrong"), "_text")
        .drop(CORRUPT_COLUMN)
    )


@operator("flag_load_rows")
def flag_load_rows(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "csv",
    sep: str = ",",
    quote: str | None = '"',
    escape: str | None = "\\",
    encoding: str = "utf-8",
    header: bool = False,
    skip_rows: int = 0,
    jagged: bool = False,
    ignore_unknown: bool = False,
    quoted_newlines: bool = False,
    null_value: str | None = None,
    eol: str | None = None,
    date_style: str | None = None,
    date_delim: str = "-",
) -> DataFrame:
    """Parse a file for loading: string columns, ``_bad`` and the record text ``_text``.

    A row is bad when its width is wrong or a cell does not fit its type. ``jagged`` allows missing trailing columns
    (NULL), ``ignore_unknown`` allows surplus ones. JSON ignores the CSV options.
    """
    names = [field.name for field in schema.fields]
    if fmt == "json":
        parsed = _parse_json(spark, path, names, ignore_unknown)
    else:
        if skip_rows:
            frame = skip_leading_rows(
                spark,
                path,
                skip_rows,
                names,
                sep=sep,
                quote=quote,
                escape=escape,
                null_value=null_value,
                encoding=encoding,
                eol=eol,
                multiline=quoted_newlines,
                corrupt=True,
            )
        else:
            frame = read_delimited(
                spark,
                path,
                sep=sep,
                quote=quote,
                escape=escape,
                encoding=encoding,
                header=header,
                null_value=null_value,
                columns=names,
                multiline=quoted_newlines,
                eol=eol,
                corrupt=True,
            )
        character = option_character(sep)
        rendered = F.concat_ws(character, *[F.coalesce(quoted(name), F.lit("")) for name in names])
        parsed = frame.select(
            *[quoted(name) for name in names],
            _wrong_width(len(names), character, quote, jagged, ignore_unknown).alias("_wrong"),
            F.coalesce(quoted(CORRUPT_COLUMN), rendered).alias("_text"),
        )
    misfit = any_of(
        quoted(name).isNotNull() & value.isNull()
        for name, value in zip(names, typed_columns(schema, date_style, date_delim))
    )
    return parsed.select(*[quoted(name) for name in names], (F.col("_wrong") | misfit).alias("_bad"), "_text")


@operator("load_file")
def load_file(
    spark: SparkSession,
    path: str,
    table: str,
    schema: T.StructType | None = None,
    max_bad: int = 0,
    write: str = "errorifexists",
    preset: str | None = None,
    create: bool = True,
    date_style: str | None = None,
    date_delim: str = "-",
    **options,
) -> DataFrame:
    """Load a file into a table; returns one row (rows_loaded, rows_bad).

    ``write`` is ``errorifexists`` (the table must be empty or absent), ``append`` or ``overwrite``. The parsed rows
    are staged once, the bad ones counted from a single pruned column, and nothing reaches the table when there are
    more than ``max_bad``.
    """
    exists = spark.catalog.tableExists(table)
    if not exists and not create:
        raise ValueError(f"table {table} does not exist")
    if schema is None:
        if not exists:
            raise ValueError("a new table needs a schema")
        schema = spark.table(table).schema
    settings = {**LOAD_PRESETS[preset]} if preset else {}
    settings.update(options)
    flagged = stage(
        flag_load_rows(spark, path, schema, date_style=date_style, date_delim=date_delim, **settings), "load"
    )
    counts = flagged.agg(
        F.count_if(~F.col("_bad")).alias("rows_loaded"), F.count_if(F.col("_bad")).alias("rows_bad")
    )
    bad = counts.first()["rows_bad"]
    if bad > max_bad:
        raise ValueError(f"{bad} bad records, at most {max_bad} allowed")
    rows = cast_rows(flagged.where(~F.col("_bad")), schema, date_style, date_delim)
    if exists and write == "errorifexists":
        if spark.table(table).limit(1).count():
            raise ValueError(f"table {table} is not empty")
        rows.write.insertInto(table)
    elif exists and write == "append":
        rows.write.insertInto(table)
    else:
        rows.write.mode(write).saveAsTable(table)
    return counts
