"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
and column names and returns a DataFrame; ``queries`` binds them to tables.
"""
