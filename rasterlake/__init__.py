"""rasterlake: collections of raster images as Spark DataFrames."""

__version__ = "0.1.0"
