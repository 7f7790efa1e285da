"""Workflow-history analytics as Spark DataFrame and Structured Streaming operators."""
