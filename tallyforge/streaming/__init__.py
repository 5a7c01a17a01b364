"""Structured Streaming forms of the generation log."""
