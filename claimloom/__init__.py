"""Evidence-graph analytics on PySpark: sources, entities and quote-backed claims as DataFrames."""
