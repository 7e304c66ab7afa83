"""Relational operators over typed DataFrames."""
