"""Scalar expressions, functions and aggregates."""
