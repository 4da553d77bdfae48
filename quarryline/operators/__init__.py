"""Operators over files, chunks, postings and vectors, each a plan from DataFrames to a DataFrame."""
