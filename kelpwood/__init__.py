"""A memory-analytics engine on Spark DataFrames."""
