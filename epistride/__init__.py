"""Episode and step analytics on Spark DataFrames."""
