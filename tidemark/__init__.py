"""Tidemark: evidence analytics on Spark DataFrames."""
