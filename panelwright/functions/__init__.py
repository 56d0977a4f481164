"""Column expressions and windows that operators are built from."""
