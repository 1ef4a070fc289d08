"""Column expressions and small scan helpers shared by the operators."""
