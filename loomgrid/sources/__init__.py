"""Readers that give raster tables."""
