"""Raster, mask and tabular analytics on Spark DataFrames."""
