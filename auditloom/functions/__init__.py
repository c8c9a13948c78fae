"""Scalar functions: URLs and text."""
