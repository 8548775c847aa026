"""Corpus spelling, terminology and text-quality analytics on Spark DataFrames."""
