"""Column expressions and row-wise transforms."""
