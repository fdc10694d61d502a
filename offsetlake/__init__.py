"""Offset-log analytics on Spark."""
