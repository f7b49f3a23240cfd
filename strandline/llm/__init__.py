"""Operators for preparing text, vectors and media for model training, as Spark jobs."""
