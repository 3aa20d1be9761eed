"""Operators for training-data pipelines over text, page and vector tables."""
