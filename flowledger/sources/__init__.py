"""Schemas, table scans, artifact scans and the views derived from the test tables."""
