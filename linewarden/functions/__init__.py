"""Column expressions: one definition of every rule, for batch and stream."""
