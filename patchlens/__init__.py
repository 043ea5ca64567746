"""Diff analytics on Spark: patches are rows, review packets are the result."""

__version__ = "0.3.0"
