"""Document and event analytics expressed as Spark DataFrames."""
