"""Recommendation and event analytics on PySpark DataFrames."""
