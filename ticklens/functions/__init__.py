"""Column expressions and parameter helpers shared by the operators."""
