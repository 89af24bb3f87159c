"""Event-population analytics on Spark DataFrames."""
