"""Readers and writers with schema checks."""
