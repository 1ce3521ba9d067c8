"""Column expressions and row-wise DataFrame transformations."""
