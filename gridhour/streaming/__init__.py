"""Structured Streaming forms of the feeds: bounded state, idempotent sinks."""
