"""Queries over the driver's tables, each with a DuckDB statement that computes the same by other means."""
