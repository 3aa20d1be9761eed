"""Pipelines: operators put together over a store."""
