"""Text expressions: hashing, encryption, concatenation, clean-up."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from feedwright.registry import operator

HASH_COLUMN = "hash_value"
# Fixed value: characters of a number in the older form of row hashes.
NUMBER_TEXT_LENGTH = 20

# Windows-1252 code points and the ISO-8859-15 code points they become.
CODE_PAGE_SWAPS = {
    0x80: 0xA4,
    0x8A: 0xA6,
    0x8C: 0xBC,
    0x8E: 0xB4,
    0x9A: 0xA8,
    0x9C: 0xBD,
    0x9E: 0xB8,
    0x9F: 0xBE,
}


def quoted(name: str) -> Column:
    """A column by its literal name, dots and reserved words included."""
    return F.col(safe_identifier(name))


@operator("safe_identifier")
def safe_identifier(name: str) -> str:
    """Quote an identifier so reserved words and odd characters are safe in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def names_of(columns: Iterable[str]) -> list[str]:
    """Quoted names for a pass-through select list; texts cost far fewer calls to the JVM than column objects."""
    return [safe_identifier(name) for name in columns]


def text_literal(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@operator("coalesce_text")
def coalesce_text(expression: Column, default: str = "") -> Column:
    """Text of an expression with NULL replaced."""
    return F.coalesce(expression.cast("string"), F.lit(default))


def _as_text(name: str, data_type: T.DataType, number_length: int | None) -> Column:
    column = quoted(name).cast("string")
    if number_length is not None and isinstance(data_type, T.NumericType):
        column = F.substring(column, 1, number_length)
    return column


@operator("concat_columns")
def concat_columns(
    df: DataFrame, columns: Sequence[str] | None = None, number_length: int | None = None
) -> Column:
    """One string from many columns: whole values as text, NULL as '', no separator.

    ``number_length=NUMBER_TEXT_LENGTH`` gives the older form, in which numbers are cut after 20 characters.
    Floating point text differs between engines; cast such columns to a decimal before comparing across systems.
    """
    types = {field.name: field.dataType for field in df.schema.fields}
    chosen = list(columns) if columns is not None else df.columns
    if not chosen:
        return F.lit("")
    return F.concat(*[coalesce_text(_as_text(name, types[name], number_length)) for name in chosen])


@operator("row_hash")
def row_hash(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, number_length: int | None = None
) -> DataFrame:
    """Keys followed by ``0x`` + upper-case MD5 of :func:`concat_columns` of the others. Narrow: no shuffle."""
    if columns is None:
        columns = [name for name in df.columns if name not in set(keys)]
    digest = F.concat(F.lit("0x"), F.upper(F.md5(concat_columns(df, columns, number_length))))
    return df.select(*[quoted(key) for key in keys], digest.alias(HASH_COLUMN))


@operator("comparison_pk")
def comparison_pk(keys: Sequence[str]) -> Column:
    """Comma-joined key values in key order; NULL parts keep their place as empty text."""
    return F.concat_ws(",", *[coalesce_text(quoted(key)) for key in keys])


@operator("encrypt_text")
def encrypt_text(expression: Column) -> Column:
    """One-way encryption: base64 of the SHA-256 digest of the text."""
    return F.base64(F.unhex(F.sha2(expression.cast("string"), 256)))


@operator("encrypt_columns")
def encrypt_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Encrypt every listed column, matched without regard to case."""
    wanted = {name.strip().lower() for name in columns}
    return df.select(
        *[
            encrypt_text(quoted(name)).alias(name) if name.lower() in wanted else quoted(name)
            for name in df.columns
        ]
    )


@operator("replace_text")
def replace_text(expression: Column, search: str, replacement: str) -> Column:
    """Literal (not regex) replacement."""
    return F.replace(expression, F.lit(search), F.lit(replacement))


@operator("escape_text")
def escape_text(expression: Column, characters: str, escape: str = "\\") -> Column:
    """Put the escape character before each listed character, in the order given."""
    for character in characters:
        expression = replace_text(expression, character, escape + character)
    return expression


@operator("fix_code_page")
def fix_code_page(expression: Column) -> Column:
    """Swap Windows-1252 code points that ISO-8859-15 places elsewhere."""
    search = "".join(chr(code) for code in CODE_PAGE_SWAPS)
    replacement = "".join(chr(code) for code in CODE_PAGE_SWAPS.values())
    return F.translate(expression, search, replacement)


@operator("strip_newlines")
def strip_newlines(df: DataFrame) -> DataFrame:
    """Line feed to carriage return inside every string cell."""
    return _map_strings(df, lambda column: F.translate(column, "\n", "\r"))


@operator("change_case_data")
def change_case_data(df: DataFrame, case: str = "upper") -> DataFrame:
    """Upper- or lower-case every string value of a result."""
    if case not in ("upper", "lower"):
        raise ValueError("case must be 'upper' or 'lower'")
    return _map_strings(df, F.upper if case == "upper" else F.lower)


@operator("global_substitute")
def global_substitute(df: DataFrame, search: str, replacement: str, skip: Iterable[str] = ()) -> DataFrame:
    """Regex find/replace on every string cell."""
    return _map_strings(df, lambda column: F.regexp_replace(column, search, replacement), skip)


def _map_strings(df: DataFrame, fn, skip: Iterable[str] = ()) -> DataFrame:
    untouched = set(skip)
    return df.select(
        *[
            fn(quoted(field.name)).alias(field.name)
            if isinstance(field.dataType, (T.StringType, T.VarcharType, T.CharType)) and field.name not in untouched
            else quoted(field.name)
            for field in df.schema.fields
        ]
    )


@operator("code_point")
def code_point(expression: Column) -> Column:
    """Unicode value of the first character."""
    return F.ascii(expression)


@operator("text_length")
def text_length(df: DataFrame, column: str, where: str | None = None) -> DataFrame:
    """Longest text of a column as one row, or the length of each row that passes ``where``.

    An empty or all-NULL column gives 65000, the fallback size for an unknown text column; a filter that keeps no row
    gives 64000.
    """
    size = F.length(quoted(column).cast("string"))
    if where is None:
        longest = F.max(size)
        return df.agg(F.when(longest > 0, longest).otherwise(65000).cast("int").alias("character_length"))
    kept = df.where(F.expr(where)).select(
        F.when(size > 0, size).otherwise(65000).cast("int").alias("character_length")
    )
    none_kept = kept.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(64000).alias("character_length"))
    return kept.unionByName(none_kept)


def row_digest(df: DataFrame, columns: Sequence[str], case_insensitive: Iterable[str] = ()) -> list[Column]:
    """128 bits of a row as two integers: its hash under two seeds, NULL told apart from every value.

    Integers, unlike text digests, fold with min/max in a hash aggregate, so rows of one key are compared with map-side
    combine and without sorting or pairing them. Two different rows agree in both with a chance of 2^-128.
    """
    folded = set(case_insensitive)
    cells = {name: safe_identifier(name) for name in columns}
    values = [f"lower({cell})" if name in folded else cell for name, cell in cells.items()]
    # The hash skips NULLs, so where they stand is hashed as well.
    nulls = [f"isnull({cell})" for name, cell in cells.items() if df.schema[name].nullable]
    return [F.expr(f"xxhash64({', '.join([str(seed), *values, *nulls])})") for seed in (1, 2)]
