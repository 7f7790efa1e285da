"""Structured Streaming forms of ingestion, fan-out, status sync and the event fold."""
