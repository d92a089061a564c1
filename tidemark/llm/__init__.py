"""Operators for large-scale training-text pipelines. Nothing outside this folder imports it."""
