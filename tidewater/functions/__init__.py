"""Column functions: indicators, sessions, patterns, statistics."""
