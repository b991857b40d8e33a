"""Spark-native ETL/ELT data operators.

Every operator takes and returns DataFrames; Catalyst plans the work. The packages are

* ``functions``  scalar expressions, projections and type mapping
* ``sources``    readers, writers, bulk load and catalog helpers
* ``operators``  joins, dimensions, validation, profiling, reconciliation, run log, hierarchies
* ``streaming``  incremental file ingestion on Structured Streaming
* ``plans``      the registered queries, their input views and their SQL oracles
"""

from feedwright.registry import OPERATORS, operator

__all__ = ["OPERATORS", "operator"]
