"""Photo-library analytics on Spark DataFrames."""
