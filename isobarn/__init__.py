"""isobarn: gridded and point time series on Spark DataFrames."""
