"""Geometry operators over DataFrames and page kernels."""
