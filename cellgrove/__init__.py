"""Point-cloud, raster and scoring operators on Spark DataFrames."""

__version__ = "0.1.0"
