"""Readers, writers, bulk load and catalog helpers."""
