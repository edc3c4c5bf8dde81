"""Operational log analytics on Spark DataFrames, in batch and in streams."""
