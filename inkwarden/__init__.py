"""Text originality, provenance and training-data analytics on Spark DataFrames."""
