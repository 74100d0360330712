"""Message-flow analytics on Spark DataFrames."""
