"""Day-partitioned warehouse analytics on Spark DataFrames."""
