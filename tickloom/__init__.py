"""Cross-sectional factor analytics on Spark DataFrames."""
