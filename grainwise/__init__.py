"""grainwise: grain-safe environmental analytics on Spark DataFrames."""
