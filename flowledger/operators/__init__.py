"""Relational operators over the history tables: DataFrames in, DataFrames out."""
