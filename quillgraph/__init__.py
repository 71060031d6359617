"""Document, triple and graph analytics on Spark DataFrames."""
