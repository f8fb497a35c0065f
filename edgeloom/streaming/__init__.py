"""Streaming forms of the result upsert."""
