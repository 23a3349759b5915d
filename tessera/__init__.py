"""Surrogate-model analytics and training-data preparation on Spark DataFrames."""
