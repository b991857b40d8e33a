"""Delimited text: readers, writers and conversions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from feedwright.functions.logic import all_of
from feedwright.functions.text import quoted, strip_newlines
from feedwright.functions.types import schema_from_headings
from feedwright.registry import operator
from feedwright.sources.records import drop_leading_lines, first_lines, quoted_records
from feedwright.staging import scratch_path, stage

CORRUPT_COLUMN = "_corrupt_record"
NULL_TEXT = "\\N"

# Option texts that stand for a character.
OPTION_CHARACTERS = {"\\t": "\t", "\\n": "\n", "\\001": "\x01"}


# Encoding names of feeds and Spark's names for them.
ENCODINGS = {"utf8": "utf-8", "latin1": "iso-8859-1", "ascii": "us-ascii"}


def encoding_name(name: str) -> str:
    """Spark's name of an encoding."""
    return ENCODINGS.get(name.lower(), name)


def option_character(value: str | None) -> str | None:
    """The character an option text stands for."""
    return OPTION_CHARACTERS.get(value, value) if value is not None else None


def text_schema(columns: Sequence[str], corrupt: bool = False) -> T.StructType:
    """All-string schema, with the malformed-record column when asked for."""
    names = list(columns) + ([CORRUPT_COLUMN] if corrupt else [])
    return T.StructType([T.StructField(name, T.StringType(), True) for name in names])


def _read_options(sep, quote, escape, encoding, null_value, multiline, eol) -> dict:
    options = {
        "sep": option_character(sep),
        "quote": quote if quote is not None else "",
        "escape": escape if escape is not None else quote,
        "encoding": encoding_name(encoding),
        "multiLine": multiline,
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT_COLUMN,
    }
    if null_value is not None:
        options["nullValue"] = null_value
    if eol is not None:
        options["lineSep"] = option_character(eol)
    return {key: value for key, value in options.items() if value is not None}


def _blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            quoted(name) if name == CORRUPT_COLUMN else F.nullif(quoted(name), F.lit("")).alias(name)
            for name in df.columns
        ]
    )


@operator("read_delimited")
def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str = ",",
    quote: str | None = '"',
    escape: str | None = "\\",
    encoding: str = "utf-8",
    header: bool = True,
    null_value: str | None = None,
    columns: Sequence[str] | None = None,
    multiline: bool = False,
    eol: str | None = None,
    corrupt: bool = False,
) -> DataFrame:
    """Delimited files as an all-string frame; blank cells are NULL.

    With ``corrupt`` a row whose width differs from the schema keeps its text in ``_corrupt_record``: that is the
    column-count check. Short rows are padded with NULL and long ones cut, as the parser does in permissive mode.
    Without ``columns`` the names come from the header rows, or are ``COLUMN_n``; files whose header has the same names in
    another order are read by name, and files with other names are an error. ``multiline`` allows newlines in quoted
    cells; large files are still read by many tasks. A quote inside an unquoted cell is plain text.
    """
    if columns is None and header:
        groups = _files_by_header(spark, path, sep, quote, escape, encoding)
        if groups:
            first = groups[0][0]
            settings = dict(sep=sep, quote=quote, escape=escape, encoding=encoding, null_value=null_value, multiline=multiline, eol=eol, corrupt=corrupt)
            order = [*first, *([CORRUPT_COLUMN] if corrupt else [])]
            parts = [
                read_delimited(spark, path if len(groups) == 1 else paths, columns=names, **settings).select(*map(quoted, order))
                for names, paths in groups
            ]
            whole = parts[0]
            for part in parts[1:]:
                whole = whole.unionByName(part)
            return whole
    options = _read_options(sep, quote, escape, encoding, null_value, multiline, eol)
    if columns is None:
        probe = spark.read.options(**options).option("header", header).csv(path)
        columns = probe.columns if header else [f"COLUMN_{i + 1}" for i in range(len(probe.columns))]
    if multiline and quote and not encoding_name(encoding or "utf-8").lower().startswith(("utf-16", "utf-32")):
        records = quoted_records(
            spark, path, sep=option_character(sep), quote=quote, escape=escape if escape is not None else quote,
            header=header, encoding=encoding_name(encoding), eol=option_character(eol),
        )
        lines = records.where("value <> ''").select("value")
        return parse_delimited_lines(lines, columns, sep, quote, escape if escape is not None else quote, null_value, corrupt=corrupt)
    frame = (
        spark.read.schema(text_schema(columns, corrupt))
        .options(**options)
        .option("header", header)
        .option("enforceSchema", True)
        .csv(path)
    )
    return _blank_to_null(frame)


HEADERS_AT_MOST = 100


def _files_by_header(spark, path, sep, quote, escape, encoding) -> list[tuple[list[str], list[str]]]:
    """(column names, files) for each different header row, the most frequent first; empty when no file has one.

    Raises when the rows are not one set of names in different orders. Files are listed only where orders differ.
    """
    heads = first_lines(spark, path, encoding_name(encoding))
    seen = heads.groupBy("line").agg(F.count("*").alias("n"), F.min("path").alias("path")).orderBy(F.desc("n"), "path").limit(HEADERS_AT_MOST + 1).collect()
    options = {**_read_options(sep, quote, escape, encoding, None, False, None), "header": True}
    names = [spark.read.options(**options).csv(row["path"]).columns for row in seen]
    for row, own in zip(seen, names, strict=True):
        if sorted(own) != sorted(names[0]):
            raise ValueError(f"header rows differ: {seen[0]['path']} has {names[0]}, {row['path']} has {own}")
    if len(seen) > HEADERS_AT_MOST:
        raise ValueError(f"more than {HEADERS_AT_MOST} different header rows")
    if len(seen) == 1:
        return [(names[0], [])]
    return [(own, [r["path"] for r in heads.where(F.col("line") == row["line"]).select("path").collect()]) for row, own in zip(seen, names, strict=True)]


@operator("number_lines")
def number_lines(spark: SparkSession, path: str | Sequence[str], encoding: str | None = None) -> DataFrame:
    """Text lines with their 1-based number inside each file: (file, line_no, value).

    Every task numbers the lines of its own splits; the number of lines before a split is the running total of split
    counts per file. Positions are staged first, so a lost executor or a second pass cannot number them differently.
    No task ever holds more than one split's lines.
    """
    reader = spark.read if encoding is None else spark.read.option("encoding", encoding)
    lines = stage(
        reader.text(path).select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("position"),
            "value",
        ),
        "lines",
    )
    return _number_positions(lines).select("file", "line_no", "value")


def _number_positions(lines: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    splits = lines.groupBy("file", "block_start").agg(
        F.count("*").alias("n_lines"), F.min("position").alias("first_position")
    )
    before = Window.partitionBy("file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "file",
        "block_start",
        "first_position",
        F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("lines_before"),
    )
    return lines.join(offsets, ["file", "block_start"]).withColumn(
        "line_no", F.col("lines_before") + F.col("position") - F.col("first_position") + 1
    )


@operator("skip_leading_rows")
def skip_leading_rows(
    spark: SparkSession,
    path: str | Sequence[str],
    skip_rows: int,
    columns: Sequence[str],
    encoding: str | None = None,
    eol: str | None = None,
    multiline: bool = False,
    **options,
) -> DataFrame:
    """Drop ``skip_rows`` lines (garbage plus header) at the start of every file, then parse the rest as CSV.

    Only a file's first split is looked at for them, in the pass that parses; they must lie in it. ``multiline`` allows
    newlines in quoted cells. Empty lines are no records.
    """
    encoding, eol = encoding and encoding_name(encoding), option_character(eol)
    quote, escape = options.get("quote", '"'), options.get("escape", "\\")
    if multiline and quote and not encoding_name(encoding or "utf-8").lower().startswith(("utf-16", "utf-32")):
        lines = quoted_records(
            spark, path, sep=option_character(options.get("sep", ",")), quote=quote, escape=escape, skip_rows=skip_rows,
            encoding=encoding, eol=eol,
        )
    else:
        lines = drop_leading_lines(spark, path, skip_rows, encoding, eol)
    return parse_delimited_lines(lines.where("value <> ''").select("value"), columns, **options)


@operator("parse_delimited_lines")
def parse_delimited_lines(
    lines: DataFrame,
    columns: Sequence[str],
    sep: str = ",",
    quote: str | None = '"',
    escape: str | None = "\\",
    null_value: str | None = None,
    line_column: str = "value",
    corrupt: bool = False,
) -> DataFrame:
    """Parse a column of delimited lines into string columns; other columns of the frame are kept."""
    options = {"sep": option_character(sep), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COLUMN}
    options["quote"] = quote if quote is not None else ""  # empty: no character is a quote
    if escape is not None:
        options["escape"] = escape
    if null_value is not None:
        options["nullValue"] = null_value
    schema = ", ".join(f"`{name}` string" for name in list(columns) + ([CORRUPT_COLUMN] if corrupt else []))
    others = [quoted(name) for name in lines.columns if name != line_column]
    parsed = lines.select(*others, F.from_csv(quoted(line_column), schema, options).alias("_row"))
    cells = [
        (F.nullif(F.col(f"_row.`{name}`"), F.lit("")) if name != CORRUPT_COLUMN else F.col(f"_row.`{name}`")).alias(name)
        for name in list(columns) + ([CORRUPT_COLUMN] if corrupt else [])
    ]
    return parsed.select(*[F.col(f"`{name}`") for name in lines.columns if name != line_column], *cells)


@operator("read_csv_with_headings_file")
def read_csv_with_headings_file(
    spark: SparkSession, path: str, headings_path: str | None = None, sep: str = ",", verbatim: bool = False, **options
) -> DataFrame:
    """A headerless CSV whose column names are the first row of a sibling ``.headers`` file.

    ``verbatim`` keeps cells as they are: quotes and escapes are not interpreted. Blank cells are NULL either way.
    """
    first = spark.read.option("sep", option_character(sep)).csv(headings_path or path + ".headers").first()
    if first is None:
        raise ValueError("the headings file is empty")
    columns = [value for value in first if value is not None]
    if verbatim:
        return (
            spark.read.schema(text_schema(columns))
            .options(sep=option_character(sep), quote="", escape="", mode="PERMISSIVE")
            .csv(path)
        )
    return read_delimited(spark, path, sep=sep, header=False, columns=columns, **options)


@operator("create_external_csv")
def create_external_csv(
    spark: SparkSession,
    table: str,
    location: str,
    headings: Sequence[str],
    type_map: Mapping[str, str] | None = None,
    sep: str = ",",
    header: bool = False,
) -> None:
    """An external table over CSV files with the schema of a headings row and a type map."""
    schema = schema_from_headings(headings, type_map)
    spark.catalog.createTable(
        table, path=location, source="csv", schema=schema, sep=option_character(sep), header=str(header).lower()
    )


@operator("table_from_string")
def table_from_string(spark: SparkSession, text: str, delimiter: str = ",") -> DataFrame:
    """A literal text as a frame: first line headings without blanks, other lines trimmed values.

    The text is a program constant, so it lives on the driver.
    """
    lines = text.split("\n")
    names = ["".join(name.split()) for name in lines[0].split(delimiter)]
    rows = []
    for line in lines[1:]:
        values = [value.strip() for value in line.split(delimiter)][: len(names)] if line else []
        rows.append(tuple(values + [None] * (len(names) - len(values))))
    return spark.createDataFrame(rows, text_schema(names))


@operator("table_from_text_column")
def table_from_text_column(
    df: DataFrame, column: str, names: Sequence[str], delimiter: str = ",", skip_first: bool = True
) -> DataFrame:
    """As :func:`table_from_string` for texts held in a column: one output row per line, trimmed values."""
    exploded = df.select(F.posexplode(F.split(quoted(column), "\n")).alias("_line", "_text"))
    if skip_first:
        exploded = exploded.where(F.col("_line") > 0)
    cells = exploded.select(F.split("_text", "\\Q" + delimiter + "\\E").alias("_cells"))
    return cells.select(
        *[F.trim(F.get("_cells", F.lit(i)), F.lit(" \t\r\n")).alias(name) for i, name in enumerate(names)]
    )


def regex_keep(validators: Mapping[str, str]) -> Column:
    """True where every named regex matches: case-insensitive, unanchored, NULL matched as ''."""
    return all_of(F.coalesce(quoted(name), F.lit("")).rlike("(?i)" + regex) for name, regex in validators.items())


@operator("regex_validators")
def regex_validators(df: DataFrame, validators: Mapping[str, str]) -> DataFrame:
    """Keep the rows where all named regexes match."""
    return df.where(regex_keep(validators))


@operator("validator_counts")
def validator_counts(df: DataFrame, validators: Mapping[str, str]) -> DataFrame:
    """One row: rows kept, rows dropped, and failures per validator (``failed_<column>``)."""
    keep = regex_keep(validators)
    return df.agg(
        F.count_if(keep).alias("rows_kept"),
        F.count_if(~keep).alias("rows_dropped"),
        *[
            F.count_if(~F.coalesce(quoted(name), F.lit("")).rlike("(?i)" + regex)).alias(f"failed_{name}")
            for name, regex in validators.items()
        ],
    )


@operator("csv_to_ndjson")
def csv_to_ndjson(
    df: DataFrame, path: str | None, validators: Mapping[str, str], mode: str = "errorifexists"
) -> tuple[DataFrame, DataFrame]:
    """Rows passing the validators written as NDJSON; returns (good rows, counts)."""
    good = regex_validators(df, validators)
    if path is not None:
        write_ndjson(good, path, mode)
    return good, validator_counts(df, validators)


@operator("write_csv")
def write_csv(
    df: DataFrame,
    path: str,
    sep: str = ",",
    quote: str | None = '"',
    escape: str | None = "\\",
    always_quote: bool = False,
    null_value: str = NULL_TEXT,
    encoding: str = "utf8",
    headers: bool = True,
    upper_headers: bool = True,
    compression: str | None = None,
    max_records_per_file: int | None = None,
    raw: bool = False,
    mode: str = "errorifexists",
) -> None:
    """Write delimited files in parallel, one part per task.

    ``raw`` joins values with the separator and quotes nothing, for loaders that read no quotes.
    """
    frame = df.toDF(*[name.upper() for name in df.columns]) if upper_headers else df
    options = {
        "sep": option_character(sep),
        "header": headers,
        "nullValue": null_value,
        "emptyValue": "",
        "encoding": encoding_name(encoding),
        "quoteAll": always_quote,
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
    }
    if raw:
        options.update(quote="\u0000", escape="\u0000", quoteAll=False)
    else:
        options["quote"] = quote or "\u0000"
        options["escape"] = escape or quote or "\u0000"
    if compression:
        options["compression"] = compression
    if max_records_per_file:
        options["maxRecordsPerFile"] = max_records_per_file
    frame.write.mode(mode).options(**options).csv(path)


# Presets for the dialects of table export.
EXPORT_PRESETS = {
    "postgres_9": {"escape": '"', "null_value": ""},
    "postgres_8": {"escape": '"', "null_value": ""},
    "bcp": {"escape": "\\", "null_value": NULL_TEXT, "headers": False},
}


@operator("export_table")
def export_table(df: DataFrame, path: str, preset: str = "postgres_9", **options) -> None:
    """Export a table or query with a dialect's defaults; any option of :func:`write_csv` overrides them."""
    write_csv(df, path, **{"upper_headers": False, **EXPORT_PRESETS[preset], **options})


@operator("export_partitioned")
def export_partitioned(
    df: DataFrame,
    directory: str,
    job_id: int | str,
    compression: str = "gzip",
    sep: str = ",",
    header: bool = True,
    max_records_per_file: int | None = None,
) -> DataFrame:
    """Full table to many compressed parts under ``job-<id>.export``; returns the listing of the parts."""
    from feedwright.sources.objects import list_objects

    target = f"{directory}/job-{job_id}.export"
    write_csv(
        df,
        target,
        sep=sep,
        headers=header,
        upper_headers=False,
        compression=compression,
        max_records_per_file=max_records_per_file,
    )
    return list_objects(df.sparkSession, target, pattern="part-*").select(
        F.col("key").alias("gs_path"), F.col("file").alias("filename")
    )


@operator("write_ndjson")
def write_ndjson(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line with NULL keys kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


@operator("transcode_csv")
def transcode_csv(
    spark: SparkSession,
    source: str,
    target: str,
    in_options: Mapping | None = None,
    out_options: Mapping | None = None,
    mangle_eols: bool = False,
) -> None:
    """Re-write a CSV with another delimiter, quote, escape or encoding; optionally LF to CR inside fields."""
    frame = read_delimited(spark, source, **dict(in_options or {}))
    if mangle_eols:
        frame = strip_newlines(frame)
    write_csv(frame, target, **{"upper_headers": False, "null_value": "", **dict(out_options or {})})


@operator("preview")
def preview(df: DataFrame, n: int = 1000) -> DataFrame:
    """First rows of a file or query."""
    return df.limit(n)


def round_trip_path(spark: SparkSession) -> str:
    """A fresh folder for a file round trip."""
    return scratch_path(spark, "files")
