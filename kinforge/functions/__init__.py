"""Column expressions and small helpers."""
