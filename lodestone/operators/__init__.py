"""Operators over DataFrames that the planner composes: paths, text search, windows, joins."""
