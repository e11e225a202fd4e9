"""Structural graph analytics on Spark DataFrames."""
