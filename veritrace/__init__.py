"""Transcript quality analytics on Spark DataFrames."""
