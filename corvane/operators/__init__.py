"""Relational operators of the catalog, as functions from DataFrames to DataFrames."""
