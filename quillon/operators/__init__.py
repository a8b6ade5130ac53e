"""Operators on triples, logs and documents; each takes and returns DataFrames."""
