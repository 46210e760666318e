"""Spatio-temporal event analytics as Spark DataFrames."""
