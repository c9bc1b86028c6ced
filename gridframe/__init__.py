"""Dense N-dimensional arrays as Spark DataFrames."""
