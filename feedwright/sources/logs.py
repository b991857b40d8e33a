"""Log lines to columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from feedwright.functions.logic import any_of
from feedwright.functions.text import quoted
from feedwright.registry import operator

# Fixed value: one line of the bulk loader's reject log.
LOAD_ERROR_LINE = (
    r'(^\d+):\s(\d+)\((\d+)\)\s\[(\d+),\s([\w\s\(\)]+)\]\s([\w\s]+),\s"(.*)"\[(.+?)\]'
)
LOAD_ERROR_FIELDS = (
    ("bad_no", "bigint"),
    ("input_row", "bigint"),
    ("byte_offset", "bigint"),
    ("field_no", "bigint"),
    ("declaration", "string"),
    ("diagnostic", "string"),
    ("text_consumed", "string"),
    ("last_char_examined", "string"),
)


def _group(column: Column, regex: str, index: int, optional: bool) -> Column:
    value = F.regexp_extract(column, regex, index)
    return F.nullif(value, F.lit("")) if optional else value


@operator("parse_log_lines")
def parse_log_lines(
    lines: DataFrame,
    regex: str,
    names: Sequence[str] | None = None,
    error_state_regex: str | None = None,
    max_parse_errors: int | None = None,
    line_column: str = "value",
    optional_groups: Sequence[int] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split log lines by a regex; returns (good, bad, counts).

    Capture groups become columns; a regex without groups gives one column holding 1. Lines that only match
    ``error_state_regex`` are known noise and go nowhere. With ``max_parse_errors`` set, more bad lines than that raise.
    Groups listed in ``optional_groups`` give NULL when they matched nothing, since Spark reports '' there.
    """
    n_groups = re.compile(regex).groups
    text = quoted(line_column)
    matched = F.coalesce(text.rlike(regex), F.lit(False))
    noise = F.coalesce(text.rlike(error_state_regex), F.lit(False)) if error_state_regex else F.lit(False)
    others = [quoted(name) for name in lines.columns if name != line_column]
    if n_groups:
        columns = list(names) if names is not None else [f"column_{i + 1}" for i in range(n_groups)]
        if len(columns) != n_groups:
            raise ValueError(f"{n_groups} groups need as many names, got {len(columns)}")
        cells = [
            _group(text, regex, i + 1, (i + 1) in set(optional_groups)).alias(name) for i, name in enumerate(columns)
        ]
    else:
        cells = [F.lit("1").alias(names[0] if names else "column_1")]
    good = lines.where(matched).select(*others, *cells)
    bad = lines.where(~matched & ~noise)
    counts = lines.agg(
        F.count("*").alias("lines_read"),
        F.count_if(matched).alias("lines_parsed"),
        F.count_if(~matched & noise).alias("error_state_lines"),
        F.count_if(~matched & ~noise).alias("bad_lines"),
    )
    if max_parse_errors is not None:
        found = counts.first()["bad_lines"]
        if found > max_parse_errors:
            raise ValueError(f"exceeded maximum parse errors: {found} > {max_parse_errors}")
    return good, bad, counts


@operator("parse_load_error_log")
def parse_load_error_log(
    log_lines: DataFrame,
    bad_lines: DataFrame,
    job_id: int,
    target_db: str,
    target_table: str,
    ordinal: str = "line_no",
    line_column: str = "value",
) -> DataFrame:
    """Rejected rows of a bulk load: eight fields of each reject line zipped with the n-th line of the bad file.

    Both frames carry ``ordinal``. The n-th reject is found by dense numbering of the reject lines, not by a
    single-partition window; the zip is an equi-join.
    """
    from feedwright.operators.numbering import number_rows

    text = quoted(line_column)
    rejects = log_lines.where(text.rlike(LOAD_ERROR_LINE)).select(
        quoted(ordinal).alias("_at"),
        *[
            F.regexp_extract(text, LOAD_ERROR_LINE, i + 1).cast(kind).alias(name)
            for i, (name, kind) in enumerate(LOAD_ERROR_FIELDS)
        ],
    )
    numbered = number_rows(rejects, ["_at"], "_n")
    records = number_rows(
        bad_lines.select(quoted(ordinal).alias("_at"), text.alias("bad_record")), ["_at"], "_n"
    ).drop("_at")
    return numbered.join(records, "_n", "left").select(
        F.lit(job_id).cast("bigint").alias("job_id"),
        *[name for name, _ in LOAD_ERROR_FIELDS],
        "bad_record",
        F.lit(target_db).alias("target_db"),
        F.lit(target_table).alias("target_table"),
    )


@operator("downgrade_errors")
def downgrade_errors(df: DataFrame, message_column: str, patterns: Sequence[str]) -> DataFrame:
    """Classify messages: any pattern that matches makes an error a warning."""
    message = F.coalesce(quoted(message_column), F.lit(""))
    matches = any_of(message.rlike(pattern) for pattern in patterns)
    return df.withColumn("severity", F.when(matches, "WARNING").otherwise("ERROR"))
