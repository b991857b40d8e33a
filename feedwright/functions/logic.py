"""Building wide conditions and lookups without deep expression trees.

A table may have hundreds of columns, and a tree as deep as the table is wide overflows the analyser's stack.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F


def _balanced(conditions: Sequence[Column], combine) -> Column:
    if len(conditions) == 1:
        return conditions[0]
    half = len(conditions) // 2
    return combine(_balanced(conditions[:half], combine), _balanced(conditions[half:], combine))


def all_of(conditions: Iterable[Column]) -> Column:
    """AND of the conditions; true without any."""
    chosen = list(conditions)
    return _balanced(chosen, lambda a, b: a & b) if chosen else F.lit(True)


def any_of(conditions: Iterable[Column]) -> Column:
    """OR of the conditions; false without any."""
    chosen = list(conditions)
    return _balanced(chosen, lambda a, b: a | b) if chosen else F.lit(False)


def first_case(pairs: Iterable[tuple[Column, Column | object]], default: Column) -> Column:
    """One flat CASE: the value of the first condition that holds."""
    result = None
    for condition, value in pairs:
        result = F.when(condition, value) if result is None else result.when(condition, value)
    return default if result is None else result.otherwise(default)


def pick(position: Column, values: Sequence[object]) -> Column:
    """The literal at a 0-based position, NULL outside."""
    return F.get(F.array(*[F.lit(value) for value in values]), position)
