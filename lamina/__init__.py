"""lamina: image-layer analytics on Spark DataFrames."""
