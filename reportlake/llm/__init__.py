"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; each module holds one operator with
its general interface, and ``queries`` binds the operators to the test tables.
"""
