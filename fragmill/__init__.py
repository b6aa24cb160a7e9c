"""fragmill: chromatin-profile analytics expressed as Spark DataFrames."""
