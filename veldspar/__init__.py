"""Vector search, metadata filters and collection management on Spark DataFrames."""
