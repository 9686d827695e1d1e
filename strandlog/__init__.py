"""Typed, timestamped event logs and their sequence statistics on Spark DataFrames."""
