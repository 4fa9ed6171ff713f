"""Evidence analytics on Spark: notes, pages and claims as DataFrames."""
