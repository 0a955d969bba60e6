"""Raster, segmentation and graph operators over DataFrames."""
