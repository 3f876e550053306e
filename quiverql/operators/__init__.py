"""Operators over graphs and documents besides the query language."""
