"""Scalar functions as column expressions: paths and names, globs, times, attributes."""
