"""Operators on graphs: each takes and returns DataFrames."""
