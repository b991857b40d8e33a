"""Joins, dimensions, validation, onboarding, reconciliation, run log and hierarchies."""
