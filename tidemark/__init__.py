"""Listing-price analytics on Spark DataFrames."""
