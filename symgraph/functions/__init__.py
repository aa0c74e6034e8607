"""Column expressions and functions of one string."""
