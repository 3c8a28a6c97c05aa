"""Operators for large-scale training-data preparation, each built by one named method.

Nothing else in the library imports this subpackage. ``queries.QUERIES`` maps
query names to callables; ``queries.ORACLE`` holds the SQL twins that exist.
"""
