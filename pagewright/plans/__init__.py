"""Compositions that users call: layout, tables, text search, page metrics."""
