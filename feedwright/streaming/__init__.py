"""Incremental file ingestion on Structured Streaming."""
