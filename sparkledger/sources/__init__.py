"""Sources of the log engine."""
