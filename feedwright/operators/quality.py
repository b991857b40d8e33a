"""Feed validation: split all-string rows into good and bad by the target table's declared types.

The check is one narrow projection. Each column yields an issue code or NULL; a row is good when all codes are NULL, so
the good branch evaluates nothing else, and the issue array is built for failing rows only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from feedwright.functions.dates import DATE_OR_TIMESTAMP_SHAPE, DATE_SHAPE
from feedwright.functions.text import global_substitute, quoted, safe_identifier, text_literal
from feedwright.operators.numbering import number_rows
from feedwright.registry import operator
from feedwright.staging import stage
from feedwright.sources.delimited import CORRUPT_COLUMN

MAX_LENGTH_EXCEEDED = "MAX_LENGTH_EXCEEDED"
NUMERIC_OVERFLOW = "NUMERIC_OVERFLOW"
DATA_TYPE_MISMATCH = "DATA_TYPE_MISMATCH"
COLUMN_COUNT = "COLUMN_COUNT"

# Shapes of numbers. Zero-padded integers such as 007 are codes, not numbers.
INTEGER_SHAPE = r"^(?!0\d+$)\s*-?\d*$"
NUMERIC_SHAPE = r"^-?\d*\.?\d*$"

# Rank of the integer types and their exclusive bounds (a value fits when -bound < value < bound).
INTEGER_RANKS = {"byteint": 0, "tinyint": 1, "smallint": 2, "int": 3, "bigint": 4}
INTEGER_BOUNDS = {
    "sql": {"byteint": 128, "smallint": 32768, "int": 2147483648},
    "as_coded": {"byteint": 0, "smallint": 327688, "int": 2147483648},
}
LOWEST_BIGINT = -9223372036854775808

ISSUES_TYPE = "array<struct<position:int,name:string,value:string,issue:string>>"
MISFIT = "VALUE DOES NOT FIT THE TYPE"
NO_ISSUES = f"cast(array() as {ISSUES_TYPE})"
ANY_ISSUE = "_any_issue"
ISSUES = "_issues"


# The rules are SQL text over a cell expression: a wide table needs one parsed expression instead of dozens of calls
# per column from Python to the JVM. A cell that passes is looked at by one regex; only failing cells are looked at again
# to find the kind of issue. A NULL cell never has an issue.


def _raw(regex: str) -> str:
    return f"r'{regex}'"


def _char_rule(cell: str, length: int) -> str:
    return f"case when greatest(length({cell}), 1) > {length} then '{MAX_LENGTH_EXCEEDED}' end"


def _timestamp_rule(cell: str) -> str:
    return f"case when not ({cell} rlike {_raw(DATE_OR_TIMESTAMP_SHAPE)}) then '{DATA_TYPE_MISMATCH}' end"


def _date_rule(cell: str) -> str:
    return f"case when not ({cell} rlike {_raw(DATE_SHAPE)}) then '{DATA_TYPE_MISMATCH}' end"


def _int_rule(cell: str, declared: str, bounds: str) -> str:
    limits, rank = INTEGER_BOUNDS[bounds], INTEGER_RANKS[declared]
    # The bounds are nested, so the widest type up to the declared one decides.
    bound = max([limit for name, limit in limits.items() if INTEGER_RANKS[name] <= rank], default=0)
    if rank == INTEGER_RANKS["bigint"]:
        bound = -LOWEST_BIGINT
    whens = []
    if bound > 1:
        # Numbers with fewer digits than the bound surely fit.
        short = INTEGER_SHAPE.replace(r"\d*$", rf"\d{{0,{len(str(bound - 1)) - 1}}}$")
        whens.append(f"when {cell} rlike {_raw(short)} then null")
    number = f"try_cast({cell} as bigint)"
    whens.append(f"when not ({cell} rlike {_raw(INTEGER_SHAPE)}) then '{DATA_TYPE_MISMATCH}'")
    whens.append(
        f"when not coalesce({number} > {LOWEST_BIGINT}, {cell} is null or trim({cell}) in ('', '-')) "
        f"then '{DATA_TYPE_MISMATCH}'"
    )
    if rank < INTEGER_RANKS["bigint"]:
        fits = f"coalesce({number}, 0) between {1 - bound} and {bound - 1}"
        whens.append(f"when {cell} is not null and not ({fits}) then '{NUMERIC_OVERFLOW}'")
    return f"case {' '.join(whens)} end"


def _numeric_rule(cell: str, precision: int | None, scale: int | None, strict: bool) -> str:
    mismatch = f"when not ({cell} rlike {_raw(NUMERIC_SHAPE)}) then '{DATA_TYPE_MISMATCH}'"
    if precision is None:
        return f"case {mismatch} end"
    # Fits: not more digits than the precision, nor after the point than the scale.
    left = rf"\d{{0,{precision - (scale or 0)}}}" if strict else r"\d*"
    fits = rf"^-?(?!(?:\.?\d){{{precision + 1}}}){left}(?:\.\d{{0,{scale or 0}}})?$"
    return (
        f"case when {cell} rlike {_raw(fits)} then null {mismatch} "
        f"when {cell} is not null then '{NUMERIC_OVERFLOW}' end"
    )


@operator("validate_char")
def validate_char(name: str, length: int) -> Column:
    """Issue code of a column: longer than declared. An empty text counts as one character."""
    return F.expr(_char_rule(safe_identifier(name), length))


@operator("validate_timestamp")
def validate_timestamp(name: str) -> Column:
    """Neither a timestamp nor a date by shape."""
    return F.expr(_timestamp_rule(safe_identifier(name)))


@operator("validate_date")
def validate_date(name: str) -> Column:
    """Not a date by shape."""
    return F.expr(_date_rule(safe_identifier(name)))


@operator("validate_int")
def validate_int(name: str, declared: str = "bigint", bounds: str = "sql") -> Column:
    """Not an integer, or needs a wider integer type than declared. Empty text and a lone minus count as 0."""
    return F.expr(_int_rule(safe_identifier(name), declared, bounds))


@operator("validate_numeric")
def validate_numeric(name: str, precision: int | None, scale: int | None, strict: bool = False) -> Column:
    """Not a plain decimal, or too many digits in total or after the point.

    Leading zeros count. The rule lets 1234567.8 into decimal(8,2); ``strict`` also limits digits before the point.
    """
    return F.expr(_numeric_rule(safe_identifier(name), precision, scale, strict))


@dataclass(frozen=True)
class Declared:
    """A target column: its type name and size text for the summary, and its rule from cell text to issue code."""

    name: str
    type_name: str
    extra: str | None
    rule: Callable[[str], str] | None


def declared_columns(
    schema: T.StructType | str, bounds: str = "sql", strict_decimal: bool = False
) -> list[Declared]:
    """Rules of a target schema (a ``StructType`` or DDL text); plain strings have none."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return [_declared(field, bounds, strict_decimal) for field in schema.fields]


def _declared(field: T.StructField, bounds: str, strict: bool) -> Declared:
    kind = field.dataType
    if isinstance(kind, (T.VarcharType, T.CharType)):
        name = "char" if isinstance(kind, T.CharType) else "varchar"
        return Declared(field.name, name, f"Length: [{kind.length}]", lambda cell: _char_rule(cell, kind.length))
    if isinstance(kind, T.StringType):
        return Declared(field.name, "string", None, None)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return Declared(field.name, "timestamp", None, _timestamp_rule)
    if isinstance(kind, T.DateType):
        return Declared(field.name, "date", None, _date_rule)
    integers = {T.ByteType: "tinyint", T.ShortType: "smallint", T.IntegerType: "int", T.LongType: "bigint"}
    if type(kind) in integers:
        name = integers[type(kind)]
        return Declared(
            field.name, name, f"Size: [{INTEGER_RANKS[name]}]", lambda cell: _int_rule(cell, name, bounds)
        )
    if isinstance(kind, T.DecimalType):
        return Declared(
            field.name,
            "decimal",
            f"Scale: [{kind.precision}], Precision: [{kind.scale}]",
            lambda cell: _numeric_rule(cell, kind.precision, kind.scale, strict),
        )
    raise ValueError(f"column {field.name}: type {kind.simpleString()} has no validation rule")


@operator("strip_extra_columns")
def strip_extra_columns(df: DataFrame, n_columns: int, keep: Sequence[str] = ()) -> DataFrame:
    """Drop data columns beyond the table's width; columns in ``keep`` are not data."""
    data = [name for name in df.columns if name not in set(keep)]
    if len(data) <= n_columns:
        return df
    return df.select(*[quoted(name) for name in data[:n_columns]], *[quoted(name) for name in keep])


@operator("check_column_count")
def check_column_count(corrupt_column: str = CORRUPT_COLUMN) -> Column:
    """COLUMN_COUNT where the reader kept the record text because its width was not the expected one."""
    return F.expr(_column_count_rule(safe_identifier(corrupt_column)))


def _column_count_rule(record: str) -> str:
    return f"case when {record} is not null then '{COLUMN_COUNT}' end"


@operator("mangle_column_count")
def mangle_column_count(df: DataFrame, corrupt_column: str = CORRUPT_COLUMN) -> DataFrame:
    """Accept short rows padded with NULL and long rows cut, as the permissive reader already did."""
    return df.drop(corrupt_column)


@operator("annotate")
def annotate(
    df: DataFrame,
    schema: T.StructType | str,
    global_sub: tuple[str, str] | None = None,
    mangle: bool = False,
    bounds: str = "sql",
    strict_decimal: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows with ``_any_issue`` (first issue code or NULL) and ``_issues``.

    Data columns are matched to the schema by position, as in a file; columns in ``keep`` (a row number) are carried
    along. A ``_corrupt_record`` column is the width check unless ``mangle`` accepts wrong widths.
    """
    if CORRUPT_COLUMN in df.columns and mangle:
        df = mangle_column_count(df)
    carried = list(keep) + ([CORRUPT_COLUMN] if CORRUPT_COLUMN in df.columns else [])
    columns = declared_columns(schema, bounds, strict_decimal)
    df = strip_extra_columns(df, len(columns), carried)
    if global_sub:
        df = global_substitute(df, global_sub[0], global_sub[1], skip=carried)
    data = [name for name in df.columns if name not in set(carried)]
    codes, issues = [], []

    def add(position: str, name: str, cell: str, code: str) -> None:
        entry = f"struct({position} as position, {name} as name, {cell} as value, {code} as issue)"
        codes.append(code)
        issues.append(f"if({code} is null, {NO_ISSUES}, cast(array({entry}) as {ISSUES_TYPE}))")

    for index, (name, declared) in enumerate(zip(data, columns)):
        if declared.rule:
            cell = safe_identifier(name)
            add(str(index), text_literal(declared.name), cell, declared.rule(cell))
    if CORRUPT_COLUMN in df.columns:
        add("cast(null as int)", "cast(null as string)", CORRUPT_COLUMN, _column_count_rule(CORRUPT_COLUMN))
    return df.selectExpr(
        *[safe_identifier(name) for name in data],
        *[safe_identifier(name) for name in carried if name != CORRUPT_COLUMN],
        f"coalesce({', '.join(['cast(null as string)', *codes])}) as {ANY_ISSUE}",
        f"concat({', '.join([NO_ISSUES, *issues])}) as {ISSUES}",
    )


def flag_misfits(annotated: DataFrame, typed: Sequence[Column]) -> DataFrame:
    """Annotated rows in which a cell that its typed expression turns into NULL is an issue as well."""
    names = [name for name in annotated.columns if name not in (ANY_ISSUE, ISSUES)][: len(typed)]
    misfit = [quoted(name).isNotNull() & value.isNull() for name, value in zip(names, typed)]
    entries = [
        F.when(
            wrong,
            F.struct(
                F.lit(index).alias("position"), F.lit(name).alias("name"), quoted(name).alias("value"), F.lit(MISFIT).alias("issue")
            ),
        )
        for index, (name, wrong) in enumerate(zip(names, misfit))
    ]
    # A cell that has an issue already is not named twice.
    known = F.transform(ISSUES, lambda issue: issue["position"])
    new = F.filter(F.array_compact(F.array(*entries)), lambda entry: ~F.coalesce(F.array_contains(known, entry["position"]), F.lit(False)))
    found = F.coalesce(quoted(ANY_ISSUE), F.when(F.size(new) > 0, F.lit(MISFIT)))
    return annotated.withColumns({ANY_ISSUE: found, ISSUES: F.concat(F.col(ISSUES), new.cast(ISSUES_TYPE))})


@operator("datacop_split")
def datacop_split(annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and bad rows of an annotated frame."""
    data = [safe_identifier(name) for name in annotated.columns if name not in (ANY_ISSUE, ISSUES)]
    good = annotated.where(quoted(ANY_ISSUE).isNull()).select(*data)
    bad = annotated.where(quoted(ANY_ISSUE).isNotNull()).select(*data, quoted(ISSUES).alias("issues"))
    return good, bad


@operator("datacop_totals")
def datacop_totals(annotated: DataFrame, job_id: int, db: str, schema_name: str, table: str) -> DataFrame:
    """One row: records validated (good) and rejected (bad)."""
    return annotated.agg(
        F.count_if(quoted(ANY_ISSUE).isNull()).alias("records_validated"),
        F.count_if(quoted(ANY_ISSUE).isNotNull()).alias("records_rejected"),
    ).select(*_identity(job_id, db, schema_name, table), "records_validated", "records_rejected")


def _identity(job_id: int, db: str, schema_name: str, table: str) -> list[Column]:
    return [
        F.lit(job_id).cast("bigint").alias("job_id"),
        F.lit(db).alias("database_name"),
        F.lit(schema_name).alias("schema_name"),
        F.lit(table).alias("table_name"),
    ]


def _lookup(values: dict[str, str]) -> Column:
    """Value of the column name in a small literal map, NULL when absent."""
    pairs = ", ".join(f"{text_literal(name)}, {text_literal(value)}" for name, value in values.items())
    return F.expr(f"try_element_at(map({pairs}), column_name)" if values else "cast(null as string)")


@operator("datacop_issues_summary")
def datacop_issues_summary(
    annotated: DataFrame, schema: T.StructType | str, job_id: int, db: str, schema_name: str, table: str
) -> DataFrame:
    """Issue count per column and issue type. Only failing rows are exploded and counts combine map-side."""
    columns = declared_columns(schema)
    found = (
        annotated.where(quoted(ANY_ISSUE).isNotNull())
        .select(F.explode_outer(ISSUES).alias("i"))
        .groupBy(F.col("i.name").alias("column_name"), F.col("i.issue").alias("issue_type"))
        .agg(F.count("*").alias("issue_count"))
    )
    names = {column.name: column for column in columns}
    type_of = _lookup({name: column.type_name for name, column in names.items()})
    extra_of = _lookup({name: column.extra for name, column in names.items() if column.extra})
    return found.select(
        *_identity(job_id, db, schema_name, table),
        "column_name",
        type_of.alias("column_type"),
        extra_of.alias("column_type_extra"),
        "issue_type",
        "issue_count",
    )


@operator("datacop_row_report")
def datacop_row_report(annotated: DataFrame, row_no: str, with_bad_record_no: bool = False) -> DataFrame:
    """One row per rejected cell: row number, position, column, value, message.

    ``with_bad_record_no`` adds the record's number in the bad file, header line included.
    """
    bad = annotated.where(quoted(ANY_ISSUE).isNotNull()).select(quoted(row_no).alias("row_no"), ISSUES)
    if with_bad_record_no:
        bad = number_rows(bad, ["row_no"], "bad_record_no", 1)
    carried = ["row_no"] + (["bad_record_no"] if with_bad_record_no else [])
    cells = bad.select(*carried, F.explode_outer(ISSUES).alias("i"))
    message = (
        F.when(F.col("i.issue") == COLUMN_COUNT, "row width differs from the expected width")
        .when(F.col("i.issue") == MAX_LENGTH_EXCEEDED, F.concat(F.lit("length "), F.length("i.value")))
        .when(F.col("i.issue") == NUMERIC_OVERFLOW, "number exceeds the declared size")
        .otherwise("value does not have the declared type")
    )
    return cells.select(
        *carried,
        F.col("i.position").alias("column_position"),
        F.col("i.name").alias("column_name"),
        F.col("i.value").alias("data_item"),
        F.col("i.issue").alias("issue_type"),
        message.alias("message"),
    )


@operator("enforce_max_issues")
def enforce_max_issues(summary: DataFrame, max_issues: int = 5) -> int:
    """Raise when more cells failed than allowed; returns the number. Wrong row widths are not cell issues."""
    found = summary.where(F.col("issue_type") != COLUMN_COUNT).agg(F.sum("issue_count")).first()[0] or 0
    if found > max_issues:
        raise ValueError(f"max issues count {max_issues} exceeded: detected {found} issues")
    return found


@dataclass(frozen=True)
class DataCopResult:
    """The frames of one validation; all lazy."""

    good: DataFrame
    bad: DataFrame
    totals: DataFrame
    summary: DataFrame
    report: DataFrame | None
    annotated: DataFrame


@operator("datacop")
def datacop(
    df: DataFrame,
    schema: T.StructType | str,
    job_id: int = 0,
    db: str = "",
    schema_name: str = "",
    table: str = "",
    global_sub: tuple[str, str] | None = None,
    mangle_column_count: bool = False,
    max_issues: int | None = None,
    bounds: str = "sql",
    strict_decimal: bool = False,
    row_no: str | None = None,
    staged: bool = False,
    fits: Sequence[Column] = (),
) -> DataCopResult:
    """Validate a feed. With ``max_issues`` the summary is computed at once and too many issues raise.

    ``fits`` has a typed expression per column, in order: a cell that is not NULL and becomes NULL by it is an issue.
    ``staged`` writes the annotated rows once and derives every frame from them, so that the feed is read and checked
    in one pass whatever number of frames is used.
    """
    annotated = annotate(
        df, schema, global_sub, mangle_column_count, bounds, strict_decimal, [row_no] if row_no else []
    )
    if fits:
        annotated = flag_misfits(annotated, fits)
    if staged:
        annotated = stage(annotated, "annotated")
    good, bad = datacop_split(annotated)
    summary = datacop_issues_summary(annotated, schema, job_id, db, schema_name, table)
    if max_issues is not None:
        enforce_max_issues(summary, max_issues)
    return DataCopResult(
        good=good.drop(row_no) if row_no else good,
        bad=bad,
        totals=datacop_totals(annotated, job_id, db, schema_name, table),
        summary=summary,
        report=datacop_row_report(annotated, row_no) if row_no else None,
        annotated=annotated,
    )
