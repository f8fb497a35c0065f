"""Relational operators of the modelling engine."""
