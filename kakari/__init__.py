"""Sentence-structure analytics on Spark: layered text, chunks, features and dependency links as DataFrames."""
