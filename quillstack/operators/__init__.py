"""Joins, aggregations, windows and jobs over the notes model."""
