"""Column expressions: rules, corrections, projections, text."""
