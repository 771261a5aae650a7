"""Sequence graphs, their walks and description lengths on Spark DataFrames."""
