"""keyfold: versioned, range-partitioned key-value data on Spark DataFrames."""
