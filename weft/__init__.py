"""weft: training-data mixtures on Spark DataFrames."""
