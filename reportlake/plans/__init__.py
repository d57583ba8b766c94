"""Registered queries over the test tables."""

from . import queries_extract, queries_intel, queries_objects, queries_runs  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
