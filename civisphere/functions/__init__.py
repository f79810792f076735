"""Column builders: each takes columns and returns a column, so plans stay inside code generation."""
