"""Operators on DataFrames: search, indexes, structure, ranking, edits, budgets."""
