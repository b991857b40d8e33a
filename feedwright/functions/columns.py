"""Column lists, projections, filters and parameter values."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from feedwright.functions.text import coalesce_text, quoted
from feedwright.registry import operator


@operator("split_columns")
def split_columns(text: str | None, upper: bool = True) -> list[str]:
    """Parse a comma list of column names: all blanks are dropped, names upper-cased unless told not to."""
    if not text:
        return []
    names = ["".join(part.split()) for part in text.split(",")]
    return [name.upper() if upper else name for name in names if name]


def _kept(names: Sequence[str], ignore: Iterable[str]) -> list[str]:
    dropped = {name.strip().lower() for name in ignore}
    return [name for name in names if name.lower() not in dropped]


@operator("format_by_type")
def format_by_type(df: DataFrame, formats: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Apply an expression per data type name (``date``, ``decimal``, ``string`` …), aliased back to the column."""
    return df.select(
        *[
            formats[field.dataType.typeName()](quoted(field.name)).alias(field.name)
            if field.dataType.typeName() in formats
            else quoted(field.name)
            for field in df.schema.fields
        ]
    )


@operator("columns_from_source")
def columns_from_source(
    df: DataFrame,
    ignore: Iterable[str] = (),
    formats: Mapping[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """All source columns but the ignored ones (any case), with optional per-type formatting."""
    kept = df.select(*[quoted(name) for name in _kept(df.columns, ignore)])
    return format_by_type(kept, formats) if formats else kept


@operator("columns_from_target")
def columns_from_target(source: DataFrame, target: DataFrame, ignore: Iterable[str] = ()) -> DataFrame:
    """The source projected to the target's column list minus the ignored ones."""
    return source.select(*[quoted(name) for name in _kept(target.columns, ignore)])


@operator("source_prefixed_columns")
def source_prefixed_columns(target: DataFrame, ignore: Iterable[str] = (), prefix: str = "source") -> list[Column]:
    """The target's column list as references into a frame aliased ``prefix``."""
    return [F.col(f"{prefix}.`{name}`") for name in _kept(target.columns, ignore)]


@operator("count_records")
def count_records(df: DataFrame, where: str | None = None) -> DataFrame:
    """Row count as a one-row frame."""
    return optional_filter(df, where).agg(F.count("*").alias("n_records"))


@operator("optional_filter")
def optional_filter(df: DataFrame, where: str | None = None) -> DataFrame:
    """Filter by a predicate text when there is one; a leading WHERE is allowed."""
    text = (where or "").strip()
    if text.lower().startswith("where"):
        text = text[5:].strip()
    return df.where(F.expr(text)) if text else df


@operator("delta_filter")
def delta_filter(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """Rows newer than the newest target row; everything when the target holds no value.

    The target maximum is a scalar subquery, so it reaches the scan as a literal and is not a join.
    """
    newest = target.select(F.max(quoted(column))).scalar()
    return source.where(newest.isNull() | (quoted(column) > newest))


@operator("stamp_columns")
def stamp_columns(df: DataFrame, extra: Mapping[str, Column | object]) -> DataFrame:
    """Add constant or computed columns (job id, load time) to a copy."""
    return df.withColumns(
        {name: value if isinstance(value, Column) else F.lit(value) for name, value in extra.items()}
    )


@operator("qualified_target")
def qualified_target(*parts: Column) -> Column:
    """Dotted name in which a missing part stays an empty string."""
    pieces: list[Column] = []
    for index, part in enumerate(parts):
        if index:
            pieces.append(F.lit("."))
        pieces.append(coalesce_text(part))
    return F.concat(*pieces)


@operator("json_args")
def json_args(text: Column) -> Column:
    """A JSON object text as a map of named values."""
    return F.from_json(text, T.MapType(T.StringType(), T.StringType()))


@operator("layered_default")
def layered_default(*layers: Column) -> Column:
    """First layer that has a value: step value, job args, group args, template default, query value."""
    return F.coalesce(*layers)


@operator("resolve_params")
def resolve_params(
    params: DataFrame,
    values: DataFrame,
    job_args: Column | None = None,
    group_args: Column | None = None,
    query_values: Column | None = None,
) -> DataFrame:
    """Parameter values of every step in ``values``' key space.

    ``params`` has (template_name, param_name, param_default); ``values`` has (template_name, param_name, step,
    param_value) plus whatever map columns the argument expressions name. ``defined`` is 1 when the step set a value.
    """

    def lookup(arguments: Column | None) -> Column:
        return F.lit(None).cast("string") if arguments is None else F.try_element_at(arguments, F.col("param_name"))

    joined = params.join(values, ["template_name", "param_name"], "left")
    return joined.withColumns(
        {
            "param_resolved": layered_default(
                F.col("param_value"),
                lookup(job_args),
                lookup(group_args),
                F.col("param_default"),
                lookup(query_values),
            ),
            "defined": F.when(F.col("param_value").isNull(), 0).otherwise(1),
        }
    )
