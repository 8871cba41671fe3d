"""Spatial analytics for two-dimensional point data on PySpark DataFrames."""

__version__ = "0.1.0"
