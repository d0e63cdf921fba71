"""Table analytics on Spark: operators, sources, query families and streaming state."""

__version__ = "0.1.0"
