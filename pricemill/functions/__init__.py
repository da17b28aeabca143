"""Column expressions: no shuffle, no Python on the rows."""
