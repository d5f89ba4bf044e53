"""Incremental bar ingest with Structured Streaming."""
