"""Operators on collections: frames of (id, vector, metadata)."""
