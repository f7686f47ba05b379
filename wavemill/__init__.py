"""wavemill: block-coded signal analytics on Spark DataFrames."""
