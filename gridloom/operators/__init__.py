"""Raster, vector and evaluation operators, DataFrame to DataFrame."""
