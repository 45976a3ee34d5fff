"""Incremental deduplication with Structured Streaming."""
