"""Structured Streaming forms: events, token accumulation, interrupt and resume, incremental ingest."""
