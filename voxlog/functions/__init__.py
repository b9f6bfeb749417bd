"""Column expressions and byte functions."""
