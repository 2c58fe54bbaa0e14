"""Column expressions and numpy functions of the factor model."""
