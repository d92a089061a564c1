"""Scalar functions on columns and on the driver."""
