"""Column expressions for the dialect's value rules."""
