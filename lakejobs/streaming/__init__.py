"""Scheduled and run-once ingestion with Structured Streaming."""
