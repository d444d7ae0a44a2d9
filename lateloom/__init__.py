"""Late-interaction retrieval and corpus preparation on Spark DataFrames."""
