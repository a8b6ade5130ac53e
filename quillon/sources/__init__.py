"""Where triples come from and where versions are kept."""
