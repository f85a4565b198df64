"""Operators of a training-data pipeline: text, tokens, vectors and pages."""
