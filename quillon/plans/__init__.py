"""Queries over triples and their compilation to DataFrame plans."""
