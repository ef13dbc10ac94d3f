"""Document-table analytics on Spark DataFrames."""
