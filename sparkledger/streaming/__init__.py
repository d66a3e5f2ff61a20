"""Streaming of the log engine."""
