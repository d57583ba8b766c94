"""Operators: DataFrame to DataFrame, for ``DataFrame.transform``."""
