"""Readers, staged publishing and upserts."""
