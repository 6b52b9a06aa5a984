"""Structured Streaming jobs over page records."""
