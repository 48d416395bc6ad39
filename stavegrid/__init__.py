"""Page-geometry analytics on Spark DataFrames."""
