"""File onboarding: type inference, names and DDL, profiling, synthetic rows, the generated load."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from feedwright.functions.dates import DATE_SHAPE, TIMESTAMP_SHAPE
from feedwright.functions.logic import pick
from feedwright.functions.text import quoted
from feedwright.operators.maintenance import insert_select
from feedwright.operators.quality import DataCopResult, datacop
from feedwright.registry import operator
from feedwright.sources.catalog import publish
from feedwright.sources.delimited import CORRUPT_COLUMN
from feedwright.sources.load import cast_rows, typed_columns
from feedwright.staging import stage

# Shapes of inferred types. A leading zero makes a code, except 0 itself.
INT_SHAPE = r"^(?:0|-\d*|[1-9]\d*|)$"
DECIMAL_SHAPE = r"^-?\d*\.\d*$"
AM_PM = ("AM", "PM")

# Exclusive magnitude bounds of the inferred integer types.
INT_WIDTHS = (
    ("BYTEINT", 127),
    ("SMALLINT", 32767),
    ("INT", 2147483647),
    ("BIGINT", 9223372036854775807),
)
EMPTY_COLUMN_LENGTH = 100
SMALL_LENGTH = 5
DEFAULT_LENGTH = 100
AM_PM_LENGTH = 25


@operator("size_varchar")
def size_varchar(longest: Column) -> Column:
    """Declared length of a text column: below 5 exact, 5 to 100 gives 100, above exact."""
    return F.when((longest > DEFAULT_LENGTH) | (longest < SMALL_LENGTH), longest).otherwise(DEFAULT_LENGTH)


@operator("infer_int_width")
def infer_int_width(magnitude: Column) -> Column:
    """Narrowest integer type name for a largest magnitude; NULL past bigint."""
    result = F.lit(None).cast("string")
    for name, bound in reversed(INT_WIDTHS):
        result = F.when(magnitude < F.lit(bound), name).otherwise(result)
    return result


@operator("classify_cell")
def classify_cell(cell: Column) -> Column:
    """INT, NUMERIC, AMPM, DATETIME, DATE or VARCHAR for one non-NULL cell.

    Integers past bigint are text. A time with AM or PM is text that needs :func:`ampm_to_timestamp`.
    """
    magnitude = F.abs(cell.try_cast("bigint"))
    fits = cell.isin("", "-") | (magnitude < F.lit(INT_WIDTHS[-1][1]))
    return (
        F.when(cell.isNull(), F.lit(None).cast("string"))
        .when(cell.rlike(INT_SHAPE), F.when(F.coalesce(fits, F.lit(False)), "INT").otherwise("VARCHAR"))
        .when(cell.rlike(DECIMAL_SHAPE), "NUMERIC")
        .when(cell.rlike(TIMESTAMP_SHAPE), F.when(F.upper(F.right(cell, F.lit(2))).isin(*AM_PM), "AMPM").otherwise("DATETIME"))
        .when(cell.rlike(DATE_SHAPE), "DATE")
        .otherwise("VARCHAR")
    )


@operator("infer_precision")
def infer_precision(cell: Column, kind: Column) -> tuple[Column, Column]:
    """Digits before and after the point of a numeric cell."""
    signed = F.startswith(cell, F.lit("-")).cast("int")
    point = F.instr(cell, ".")
    left = F.when(kind == "NUMERIC", point - 1 - signed).when(kind == "INT", F.length(cell) - signed)
    right = F.when(kind == "NUMERIC", F.length(cell) - point).when(kind == "INT", 0)
    return left, right


@operator("infer_columns")
def infer_columns(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Logical type of every column of an all-string frame, as one row per column.

    One pass over the rows: each row becomes one small fact per column, and the facts are folded per column with
    map-side combine, so the shuffle carries one row per column and task. The merge does not depend on row order:
    INT widens to NUMERIC, DATE to DATETIME, any other mix is VARCHAR, a column without values is VARCHAR(100).
    """
    rows = df.limit(limit) if limit else df
    facts = rows.select(
        F.posexplode(F.array(*[quoted(name) for name in df.columns])).alias("position", "cell")
    )
    kind = facts.select("position", "cell", classify_cell(F.col("cell")).alias("kind"))
    left, right = infer_precision(F.col("cell"), F.col("kind"))

    def seen(name: str) -> Column:
        return F.max((F.col("kind") == name).cast("int"))

    folded = kind.groupBy("position").agg(
        F.coalesce(seen("INT"), F.lit(0)).alias("has_int"),
        F.coalesce(seen("NUMERIC"), F.lit(0)).alias("has_numeric"),
        F.coalesce(seen("DATE"), F.lit(0)).alias("has_date"),
        F.coalesce(seen("DATETIME"), F.lit(0)).alias("has_datetime"),
        F.coalesce(seen("AMPM"), F.lit(0)).alias("has_ampm"),
        F.coalesce(seen("VARCHAR"), F.lit(0)).alias("has_varchar"),
        F.max(F.when(F.col("cell").isNotNull(), F.greatest(F.length("cell"), F.lit(1)))).alias("longest"),
        F.max(F.when(F.col("kind") == "INT", F.coalesce(F.abs(F.col("cell").try_cast("bigint")), F.lit(0)))).alias(
            "magnitude"
        ),
        F.max(left).alias("left_digits"),
        F.max(right).alias("right_digits"),
    )
    numbers = F.col("has_int") + F.col("has_numeric") > 0
    dates = F.col("has_date") + F.col("has_datetime") > 0
    text = (F.col("has_varchar") + F.col("has_ampm") > 0) | (numbers & dates)
    logical = (
        F.when(text | (~numbers & ~dates), "VARCHAR")
        .when(F.col("has_numeric") == 1, "NUMERIC")
        .when(numbers, "INT")
        .when(F.col("has_datetime") == 1, "DATETIME")
        .otherwise("DATE")
    )
    # A frame without rows still has columns: start from the names.
    positions = df.sparkSession.range(len(df.columns)).select(F.col("id").cast("int").alias("position"))
    merged = positions.join(folded, "position", "left")
    longest = F.coalesce(F.col("longest"), F.lit(EMPTY_COLUMN_LENGTH))
    longest = F.when(F.col("has_ampm") == 1, F.greatest(longest, F.lit(AM_PM_LENGTH))).otherwise(longest)
    logical = F.coalesce(F.when(F.col("has_int").isNotNull(), logical), F.lit("VARCHAR"))
    return merged.select(
        (F.col("position") + 1).cast("int").alias("id"),
        pick(F.col("position"), df.columns).alias("name"),
        logical.alias("logical_type"),
        F.when(logical == "VARCHAR", size_varchar(longest)).cast("int").alias("varchar_length"),
        F.when(logical == "INT", infer_int_width(F.col("magnitude"))).alias("int_width"),
        F.when(logical == "NUMERIC", F.col("left_digits") + F.col("right_digits")).cast("int").alias("precision"),
        F.when(logical == "NUMERIC", F.col("right_digits")).cast("int").alias("scale"),
        F.when(F.col("has_ampm") == 1, "ampm_to_timestamp").alias("mangler"),
    )


# Type texts per dialect: names of the integer widths and of the other logical types.
DIALECTS = {
    "generic": {"BYTEINT": "BYTEINT", "SMALLINT": "SMALLINT", "INT": "INT", "BIGINT": "BIGINT", "DATETIME": "DATETIME"},
    "postgres": {
        "BYTEINT": "SMALLINT",
        "SMALLINT": "SMALLINT",
        "INT": "INT",
        "BIGINT": "BIGINT",
        "DATETIME": "TIMESTAMP",
    },
    "mysql": {"BYTEINT": "TINYINT", "SMALLINT": "SMALLINT", "INT": "INT", "BIGINT": "BIGINT", "DATETIME": "DATETIME"},
    "spark": {"BYTEINT": "TINYINT", "SMALLINT": "SMALLINT", "INT": "INT", "BIGINT": "BIGINT", "DATETIME": "TIMESTAMP"},
}
# The cloud warehouse has no sizes: logical type to type name.
WAREHOUSE_TYPES = {"VARCHAR": "STRING", "INT": "INTEGER", "DATE": "DATE", "NUMERIC": "FLOAT", "DATETIME": "STRING"}
MAX_SPARK_PRECISION = 38


@operator("map_inferred_type")
def map_inferred_type(dialect: str) -> Column:
    """Type text of a dialect from the columns of :func:`infer_columns`."""
    logical = F.col("logical_type")
    if dialect == "bigquery":
        result = F.lit("STRING")
        for name, text in WAREHOUSE_TYPES.items():
            result = F.when(logical == name, text).otherwise(result)
        return result
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}")
    names = DIALECTS[dialect]
    width = F.lit(None).cast("string")
    for name, _ in INT_WIDTHS:
        width = F.when(F.col("int_width") == name, names[name]).otherwise(width)
    decimal = "DECIMAL" if dialect == "spark" else "NUMERIC"
    sized = F.concat(F.lit(f"{decimal}("), F.col("precision"), F.lit(","), F.col("scale"), F.lit(")"))
    if dialect == "spark":
        sized = F.when(F.col("precision") > MAX_SPARK_PRECISION, "STRING").otherwise(sized)
    return (
        F.when(logical == "VARCHAR", F.concat(F.lit("VARCHAR("), F.col("varchar_length"), F.lit(")")))
        .when(logical == "INT", width)
        .when(logical == "NUMERIC", sized)
        .when(logical == "DATETIME", names["DATETIME"])
        .otherwise("DATE")
    )


@operator("infer_types")
def infer_types(df: DataFrame, dialect: str = "spark", limit: int | None = None) -> DataFrame:
    """Column definitions for a new table: id, include, name, type, mangler, originalname.

    ``limit`` is the "lines to read" of an interactive session; by default every line is read.
    """
    return infer_columns(df, limit).select(
        "id",
        F.lit(1).alias("include"),
        "name",
        map_inferred_type(dialect).alias("type"),
        "mangler",
        F.col("name").alias("originalname"),
    )


@operator("ddl_from_inference")
def ddl_from_inference(definitions: DataFrame, dialect: str = "spark") -> str:
    """Column list text (or a JSON field list for the cloud warehouse); one row per column, so it is collected."""
    import json

    rows = definitions.where("include = 1").orderBy("id").collect()
    if dialect == "bigquery":
        return json.dumps([{"name": row["name"], "type": row["type"]} for row in rows])
    return "(" + ", ".join(f"{row['name']} {row['type']}" for row in rows) + ")"


@operator("detect_date_style")
def detect_date_style(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order of the date parts per column, NULL when undecided, with the delimiters seen.

    A part above 31 is the year and a part above 12 the day. The largest value of each part over all rows decides.
    """
    chosen = list(columns or df.columns)
    spark = df.sparkSession
    cells = df.select(
        F.posexplode(F.array(*[quoted(name).cast("string") for name in chosen])).alias("position", "cell")
    ).where(F.col("cell").rlike(TIMESTAMP_SHAPE) | F.col("cell").rlike(DATE_SHAPE))
    start = r"^(\d+)([-/])(\d+)[-/](\d+)"
    time_delimiter = F.regexp_extract("cell", r"\s\d+(:)", 1)
    parts = cells.select(
        "position",
        *[F.regexp_extract("cell", start, group).try_cast("int").alias(f"d{i}") for i, group in ((1, 1), (2, 3), (3, 4))],
        F.regexp_extract("cell", start, 2).alias("date_delim"),
        F.nullif(time_delimiter, F.lit("")).alias("time_delim"),
    )
    top = parts.groupBy("position").agg(
        *[F.max(f"d{i}").alias(f"d{i}") for i in (1, 2, 3)],
        F.min("date_delim").alias("date_delim"),
        F.min("time_delim").alias("time_delim"),
    )
    positions = spark.range(len(chosen)).select(F.col("id").cast("int").alias("position"))
    return positions.join(top, "position", "left").select(
        pick(F.col("position"), chosen).alias("name"),
        date_style_of(F.col("d1"), F.col("d2"), F.col("d3")).alias("date_style"),
        "date_delim",
        "time_delim",
    )


@operator("date_style_of")
def date_style_of(d1: Column, d2: Column, d3: Column) -> Column:
    """Date style from three numeric parts."""
    undecided = F.lit(None).cast("string")
    return (
        F.when(d1 > 31, F.when(d2 > 12, "YDM").when(d3 > 12, "YMD").otherwise(undecided))
        .when(d2 > 31, F.when(d1 > 12, "DYM").when(d3 > 12, "MYD").otherwise(undecided))
        .when(d3 > 31, F.when(d1 > 12, "DMY").when(d2 > 12, "MDY").otherwise(undecided))
    )


@operator("mangle_column_names")
def mangle_column_names(
    headings: Sequence[str | None] | int, manglers: Iterable[tuple[str, str]] = ()
) -> list[str]:
    """Clean headings with ordered regex find/replace.

    An empty heading becomes ``NAMELESS_COLUMN_n`` and blanks become ``_``. A number instead of headings means there is
    no header: ``COLUMN_n``.
    """
    if isinstance(headings, int):
        return [f"COLUMN_{i + 1}" for i in range(headings)]
    names, nameless = [], 0
    for heading in headings:
        if not heading:
            nameless += 1
            heading = f"NAMELESS_COLUMN_{nameless}"
        for find, replacement in manglers:
            heading = re.sub(find, replacement, heading)
        names.append(re.sub(r"\s", "_", heading))
    return names


@operator("rename_columns")
def rename_columns(df: DataFrame, manglers: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """Apply :func:`mangle_column_names` to a frame."""
    return df.toDF(*mangle_column_names(df.columns, list(manglers)))


@operator("table_name_from_path")
def table_name_from_path(path: Column) -> Column:
    """Table name of a file: base name without extension, dashes to underscores, ``D_`` before a leading digit."""
    base = F.regexp_extract(path, r"([\w-]*)\.\w*$", 1)
    return F.regexp_replace(F.replace(base, F.lit("-"), F.lit("_")), r"^(\d)", "D_$1")


@operator("unique_values")
def unique_values(df: DataFrame, column: str, ordered: bool = True) -> DataFrame:
    """Non-NULL values of a column with counts, most frequent first."""
    counted = (
        df.where(quoted(column).isNotNull())
        .groupBy(quoted(column).cast("string").alias("unique_values"))
        .agg(F.count("*").alias("count"))
    )
    return counted.orderBy(F.desc("count"), "unique_values") if ordered else counted


def _value_counts(df: DataFrame, columns: Sequence[str], min_count: int) -> DataFrame:
    """(profiled_field, value, count_of_field) with count above the minimum: one pass for all columns.

    Rows become one (position, value) pair per column and are counted with map-side combine.
    """
    cells = df.select(
        F.posexplode(F.array(*[quoted(name).cast("string") for name in columns])).alias("position", "value")
    )
    counted = cells.groupBy("position", "value").agg(F.count("*").alias("count_of_field"))
    return counted.where(F.col("count_of_field") > min_count).select(
        "value", "count_of_field", pick(F.col("position"), columns).alias("profiled_field")
    )


@operator("profile_preview")
def profile_preview(df: DataFrame, min_count: int = 10, ordered: bool = True) -> DataFrame:
    """Value, count and column name where the count is above the minimum, most frequent first."""
    counted = _value_counts(df, df.columns, min_count)
    return counted.orderBy(F.desc("count_of_field"), "profiled_field", "value") if ordered else counted


@operator("top_values")
def top_values(df: DataFrame, by: str, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per group.

    The rank filter is applied in two steps, first within (group, slice), so that a group holding most of the rows is
    ranked by many tasks and at most ``n`` rows per slice reach the final task.
    """
    slices = F.pmod(F.xxhash64(*[quoted(name) for name in df.columns]), F.lit(64))
    inner = Window.partitionBy(quoted(by), F.col("_slice")).orderBy(*order)
    outer = Window.partitionBy(quoted(by)).orderBy(*order)
    return (
        df.withColumn("_slice", slices)
        .withColumn("_rank", F.row_number().over(inner))
        .where(F.col("_rank") <= n)
        .drop("_slice", "_rank")
        .withColumn("_rank", F.row_number().over(outer))
        .where(F.col("_rank") <= n)
        .drop("_rank")
    )


@operator("profile_table")
def profile_table(
    df: DataFrame,
    cutoff_percent: float = 1,
    values_limit: int = 100,
    min_count: int = 10,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Most frequent values of every column with their share of all rows.

    Only values occurring more than ``min_count`` times, the first ``values_limit`` per column by count then value, and
    only columns whose most frequent value is above ``cutoff_percent``. Share is ``DECIMAL(6,3)`` percent.

    A sketch of heavy hitters per column, over hashes of the values, names candidates; a second pass counts those exactly,
    so neither pass shuffles more than a bounded number of rows per task and column. A column is settled when its
    candidates make up all rows, or enough of them are above the error bound of the sketch, or neither they nor the bound
    reach the cutoff. Only columns that are not settled are counted in full.
    """
    chosen = list(columns or df.columns)
    total, candidates = _heavy_hitters(df, chosen)
    position = F.col("position")
    cells = df.select(F.posexplode(F.array(*[quoted(name).cast("string") for name in chosen])).alias("position", "value"))
    likely = cells.withColumn("hash", F.xxhash64("value")).join(F.broadcast(candidates), ["position", "hash"], "left_semi")
    exact = stage(likely.groupBy("position", "value").agg(F.count("*").alias("count_of_field")), "profile")
    bound = math.ceil(SKETCH_ERROR * total)
    facts = exact.groupBy("position").agg(
        F.sum("count_of_field").alias("seen"), F.max("count_of_field").alias("best"), F.count_if(F.col("count_of_field") > max(bound, min_count)).alias("sure")
    )
    by_position = {row["position"]: row for row in facts.collect()}  # one row per column

    def settled(k: int) -> bool:
        row = by_position.get(k)
        low = lambda n: 100 * n < total * cutoff_percent
        if row is None:
            return low(bound)
        return row["seen"] == total or row["sure"] >= values_limit or (low(bound) and low(row["best"]))

    done = [k for k in range(len(chosen)) if settled(k)]
    rest = [name for k, name in enumerate(chosen) if k not in done]
    counted = exact.where((F.col("count_of_field") > min_count) & position.isin(done)).select(
        "value", "count_of_field", pick(position, chosen).alias("profiled_field")
    )
    if rest:
        counted = counted.unionByName(_value_counts(df, rest, min_count))
    percent = (F.col("count_of_field").cast("double") / F.lit(float(total)) * 100).cast("decimal(6,3)")
    order = [F.desc("count_of_field"), F.asc_nulls_last("value")]
    top = top_values(counted, "profiled_field", order, values_limit)
    shares = top.withColumn("value_percent", percent)
    best = F.max("value_percent").over(Window.partitionBy("profiled_field"))
    return (
        shares.withColumn("_best", best)
        .where(F.col("_best") > F.lit(str(cutoff_percent)).cast("decimal(10,3)"))
        .select("value", "count_of_field", "value_percent", "profiled_field")
    )


TRACKED_VALUES = 2048
# Twice the error of a frequent-items sketch whose map has 4096 places: a value with a larger share is always named.
SKETCH_ERROR = 2 * 3.5 / 4096


def _heavy_hitters(df: DataFrame, columns: Sequence[str]) -> tuple[int, DataFrame]:
    """(number of rows, candidates (position, hash)): one pass, a merged sketch of bounded size per column."""
    sketches = [F.expr(f"approx_top_k_accumulate(_h{k}, {TRACKED_VALUES})").alias(f"_s{k}") for k in range(len(columns))]
    hashed = df.select(*[F.xxhash64(quoted(name).cast("string")).alias(f"_h{k}") for k, name in enumerate(columns)])
    folded = stage(hashed.agg(F.count("*").alias("_n"), *sketches), "sketches")
    named = [F.expr(f"transform(approx_top_k_estimate(_s{k}, {TRACKED_VALUES}), x -> struct({k} as position, x.item as hash))") for k in range(len(columns))]
    return folded.first()["_n"], folded.select(F.explode(F.flatten(F.array(*named))).alias("c")).select("c.*")


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ "
# Span of generated timestamps (seconds from year 1000) and length of generated text.
TIMESTAMP_SPAN = 284012524800
TIMESTAMP_ORIGIN = -30610224000
TEXT_LENGTH = 1000
DOUBLE_DIGITS = 6


@operator("generate_rows")
def generate_rows(
    spark: SparkSession,
    schema: T.StructType | str,
    n: int | None = None,
    seed: int = 0,
    serial: Sequence[str] = (),
    base: DataFrame | None = None,
    row_id: str = "id",
) -> DataFrame:
    """Synthetic rows by column type.

    Values are hashes of (seed, column, row id), so any task can recompute any row. Row ids are ``0 … n-1``, or the
    ``row_id`` column of ``base``. Serial columns take the row number, integers are uniform from 0 to the type's
    maximum, decimals have random digits, char and text random letters, timestamps are uniform over the span.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    ids = base.select(quoted(row_id).alias("_id")) if base is not None else spark.range(n).select(F.col("id").alias("_id"))

    def draw(column: int, part: int, modulus: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(column), F.lit(part), F.col("_id")), F.lit(modulus))

    def letters(column: int, length: int) -> Column:
        # One hash per letter; the sequence keeps the expression small however long the text is.
        return F.array_join(
            F.transform(
                F.sequence(F.lit(1), F.lit(length)),
                lambda i: F.substring(
                    F.lit(LETTERS),
                    (F.pmod(F.xxhash64(F.lit(seed), F.lit(column), i, F.col("_id")), F.lit(len(LETTERS))) + 1).cast("int"),
                    F.lit(1),
                ),
            ),
            "",
        )

    def value(index: int, field: T.StructField) -> Column:
        kind = field.dataType
        if field.name in set(serial):
            return (F.col("_id") + 1).cast(kind)
        if isinstance(kind, (T.VarcharType, T.CharType)):
            return letters(index, kind.length)
        if isinstance(kind, T.StringType):
            return letters(index, TEXT_LENGTH)
        limits = {T.ByteType: 2**7, T.ShortType: 2**15, T.IntegerType: 2**31}
        if type(kind) in limits:
            return draw(index, 0, limits[type(kind)]).cast(kind)
        if isinstance(kind, T.LongType):
            return F.xxhash64(F.lit(seed), F.lit(index), F.col("_id")).bitwiseAND(F.lit(2**63 - 1))
        if isinstance(kind, T.DecimalType):
            digits = [draw(index, i, 10).cast("string") for i in range(kind.precision)]
            whole, fraction = digits[: kind.precision - kind.scale], digits[kind.precision - kind.scale :]
            parts = [F.lit("0"), *whole] + ([F.lit("."), *fraction] if fraction else [])
            return F.concat(*parts).cast(kind)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            scale = 10**DOUBLE_DIGITS
            return (draw(index, 0, scale) + draw(index, 1, scale) / scale).cast(kind)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            seconds = draw(index, 0, TIMESTAMP_SPAN + 1) + F.lit(TIMESTAMP_ORIGIN)
            return F.timestamp_seconds(seconds).cast(kind)
        raise ValueError(f"column {field.name}: cannot generate {kind.simpleString()}")

    return ids.select(*[value(i, field).alias(field.name) for i, field in enumerate(schema.fields)])


@operator("onboard_feed")
def onboard_feed(
    spark: SparkSession,
    feed: DataFrame,
    staging_table: str,
    target_table: str,
    job_id: int = 0,
    max_issues: int | None = 5,
    date_style: str | None = None,
    extra: dict | None = None,
    dry_run: bool = False,
) -> DataCopResult:
    """The generated load of a feed: validate, replace the staging table by the good rows, insert into the target.

    The target's schema drives the validation, and a cell that passes it by shape but has no value of its type (month
    99, a lone minus) makes its row a bad one: no cell is lost on the way. Nothing is published when there are too many issues or on ``dry_run``.
    """
    target = spark.table(target_table)
    stamped = set(extra or {})
    schema = T.StructType([field for field in target.schema.fields if field.name not in stamped])
    names = [field.name for field in schema.fields]
    data = [name for name in feed.columns if name != CORRUPT_COLUMN]
    renamed = feed.withColumnsRenamed(dict(zip(data, names)))
    result = datacop(
        renamed,
        schema,
        job_id=job_id,
        table=target_table,
        max_issues=max_issues,
        staged=True,
        fits=typed_columns(schema, date_style, loose=True),
    )
    if not dry_run:
        publish(spark, {staging_table: cast_rows(result.good, schema, date_style, loose=True)})
        rows = insert_select(target.where(F.lit(False)), spark.table(staging_table), extra=extra)
        rows.write.insertInto(target_table)
    return result
