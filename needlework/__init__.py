"""Substring top-k retrieval and corpus processing on Spark DataFrames."""
