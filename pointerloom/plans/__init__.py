"""Whole pipelines, and the registered queries with their SQL."""
