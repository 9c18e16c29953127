"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to DataFrames; ``queries`` holds the thin registered queries.
"""
