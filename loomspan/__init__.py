"""loomspan: evidence analytics and training-data operators as Spark DataFrames."""
