"""Plans of the log engine."""
