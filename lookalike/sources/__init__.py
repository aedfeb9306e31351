"""Listings and contents of files as DataFrames."""
