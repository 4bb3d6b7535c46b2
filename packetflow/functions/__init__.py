"""Column expressions and reference dimensions."""
