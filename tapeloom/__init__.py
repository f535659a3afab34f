"""Order-book analytics on Spark DataFrames."""
