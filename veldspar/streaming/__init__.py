"""Structured Streaming forms of the operation metrics."""
