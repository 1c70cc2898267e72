"""Whole jobs, as functions from DataFrames to DataFrames."""
