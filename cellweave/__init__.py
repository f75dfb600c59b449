"""cellweave: raster tiles as ordinary Spark columns, and operators on them."""

__version__ = "0.1.0"
