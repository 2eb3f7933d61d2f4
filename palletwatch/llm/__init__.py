"""Operators for preparing training data, each by its own method, as Spark jobs."""
