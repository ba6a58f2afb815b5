"""Conditional barrier-touch analytics on Spark."""
