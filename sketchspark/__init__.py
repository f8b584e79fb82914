"""Mergeable sketches and approximate analytics on Spark DataFrames."""
