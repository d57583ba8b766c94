"""Spark-native analysis of report collections and the structured intelligence derived from them."""
