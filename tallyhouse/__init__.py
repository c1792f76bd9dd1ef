"""Venue operations analytics on Spark DataFrames."""
