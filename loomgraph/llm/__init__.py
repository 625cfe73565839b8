"""Training-data operators on Spark DataFrames.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
