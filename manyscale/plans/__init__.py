"""Reusable physical strategies: partial sums, block joins, stored intermediates."""
