"""quillon: entity-attribute-value analytics on Spark DataFrames."""
