"""Nearest-neighbour analytics and corpus processing on Spark DataFrames."""
