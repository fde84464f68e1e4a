"""Structured Streaming versions of the batch tables."""
