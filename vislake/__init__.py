"""vislake: visibility analytics on Spark DataFrames."""
