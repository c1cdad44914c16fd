"""Road-geometry analytics on Spark DataFrames."""
