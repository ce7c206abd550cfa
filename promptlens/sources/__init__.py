"""Readers, writers and provenance."""
