"""Column builders and special functions."""
