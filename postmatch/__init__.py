"""Collect, deduplicate and match postings with Spark DataFrames."""
