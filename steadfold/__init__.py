"""Robust aggregation of vectors on Spark DataFrames."""
