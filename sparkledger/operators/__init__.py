"""Operators of the log engine."""
