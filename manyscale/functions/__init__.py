"""Column expressions, Arrow batch helpers and metrics."""
