"""Typed, nested message datasets and training-data pipelines as ordinary Spark jobs."""
