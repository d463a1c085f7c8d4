"""Memory store, hybrid retrieval and conversation analytics on Spark DataFrames."""
