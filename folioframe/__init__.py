"""Document analytics on Spark: layout tables in, DataFrames out."""
