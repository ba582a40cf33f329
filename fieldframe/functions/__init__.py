"""Column expressions: cleaning, parsing, units, names."""
