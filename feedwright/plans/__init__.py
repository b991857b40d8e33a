"""Registered queries, their input views and their SQL oracles."""

import importlib

QUERY_MODULES = (
    "dimension_queries",
    "quality_queries",
    "expression_queries",
    "onboarding_queries",
    "source_queries",
    "runlog_queries",
)


def load_queries() -> None:
    """Import every query module, which registers its queries."""
    for name in QUERY_MODULES:
        importlib.import_module(f"feedwright.plans.{name}")
