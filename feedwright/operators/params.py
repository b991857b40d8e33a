"""Query parameters and iteration."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Row

from feedwright.registry import operator
from feedwright.staging import stage

BRANCHES = 100


@operator("query_params")
def query_params(df: DataFrame) -> dict:
    """First row of a query as named values (blanks in names become ``_``), for ``args=`` of later SQL."""
    row = df.first()
    return {} if row is None else {name.replace(" ", "_"): row[name] for name in df.columns}


@operator("for_each_row")
def for_each_row(control: DataFrame, fn: Callable[[Row], DataFrame], branches: int = BRANCHES) -> DataFrame | None:
    """Union of ``fn(row)`` over a control frame, None for an empty one.

    Each row is a branch of a plan. Rows are taken from the frame one after the other, and after every ``branches`` of
    them the union so far is staged, so neither the driver nor a plan holds more. Where ``fn`` is a join or filter by
    the row's values, joining with the control frame does the same in one pass.
    """
    frames: list[DataFrame] = []
    staged: list[DataFrame] = []
    for row in control.toLocalIterator():
        frames.append(fn(row))
        if len(frames) == branches:
            staged.append(stage(reduce(DataFrame.unionByName, frames), "rows"))
            frames = []
    parts = staged + frames
    return reduce(DataFrame.unionByName, parts) if parts else None
