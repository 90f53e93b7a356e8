"""Queries over the supplied tables, one or more per operator, and the SQL that states what they compute."""
