"""Scalar helpers: identifiers, hybrid logical clocks, value equality and document predicates."""
