"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; each module holds one operator with
a general interface, and ``queries`` holds the thin registered queries.
"""
