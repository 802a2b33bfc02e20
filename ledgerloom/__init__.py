"""Document extraction and spend analytics on Spark DataFrames."""
