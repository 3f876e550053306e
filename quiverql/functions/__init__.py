"""Scalar and aggregate functions of the query language as Spark columns."""
