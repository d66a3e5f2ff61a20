"""Functions of the log engine."""
