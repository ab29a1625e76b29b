"""Column expressions: names and paths, document rules."""
