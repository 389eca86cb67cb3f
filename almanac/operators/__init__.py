"""Operators on whole DataFrames: preparation, resolution, budgets, views."""
