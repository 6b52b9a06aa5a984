"""Readers, writers and derived input tables."""
