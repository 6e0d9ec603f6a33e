"""korpuscle: corpus analytics on Spark DataFrames."""
