"""Hierarchical text classification analytics on PySpark DataFrames."""
