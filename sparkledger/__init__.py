"""Analytics over append-only logs and the descriptors that govern them, on Spark DataFrames."""
