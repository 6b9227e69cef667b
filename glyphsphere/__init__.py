"""Geometric and semantic analytics on Spark DataFrames."""
