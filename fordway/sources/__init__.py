"""Readers, writers, tag filters and paths."""
