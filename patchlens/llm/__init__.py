"""Operators for training-data pipelines. Nothing else in the repository imports this package."""
