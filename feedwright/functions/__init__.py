"""Scalar expressions, projections and type mapping."""
