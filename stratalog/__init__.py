"""Versioned-log analytics on Spark DataFrames."""
