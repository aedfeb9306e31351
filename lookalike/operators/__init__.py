"""Operators on DataFrames: groups, the bit-sampling index, components, selection, reports, and the analysis cache."""
