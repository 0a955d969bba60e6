"""Raster and graph analytics on Spark DataFrames, and operators for training-data corpora."""
