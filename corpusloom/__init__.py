"""Retrieval, evaluation and corpus-preparation jobs on Spark DataFrames."""
