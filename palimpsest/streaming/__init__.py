"""Structured Streaming forms of the event inbox."""
