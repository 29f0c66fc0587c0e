"""Source analytics on Spark DataFrames."""
