"""Extension point: a plain name -> function registry of operators."""

from __future__ import annotations

from collections.abc import Callable

OPERATORS: dict[str, Callable] = {}


def operator(name: str) -> Callable[[Callable], Callable]:
    """Register a function under ``name``; user code extends the library the same way."""

    def register(fn: Callable) -> Callable:
        if name in OPERATORS:
            raise ValueError(f"operator {name!r} is already registered")
        OPERATORS[name] = fn
        return fn

    return register


def run_operator(name: str, *args, **kwargs):
    """Call a registered operator by name."""
    if name not in OPERATORS:
        raise KeyError(f"unknown operator {name!r}")
    return OPERATORS[name](*args, **kwargs)
