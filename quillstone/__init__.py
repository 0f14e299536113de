"""Disclosure analytics on Spark DataFrames."""
