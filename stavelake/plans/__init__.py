"""Queries over the given tables, each with SQL for comparison."""
