"""Column expressions and ordered passes shared by the operators."""
