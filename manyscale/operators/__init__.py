"""DataFrame operators, grouped by topic."""
