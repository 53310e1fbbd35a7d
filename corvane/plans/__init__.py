"""Planners: what would be fetched, matched or expanded, decided offline over whole DataFrames."""
