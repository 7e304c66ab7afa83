"""Training-data operators: ten large-scale text operations on Spark DataFrames.

Nothing else in the library imports this subpackage.
"""
