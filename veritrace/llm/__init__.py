"""Operators for building large training corpora with Spark."""
