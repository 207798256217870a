"""Letterloom: document analytics on Spark DataFrames."""
