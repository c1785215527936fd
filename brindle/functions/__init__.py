"""Column builders: predicates, string functions, JSON members."""
