"""Scalar functions: every one takes and returns Spark Columns."""
