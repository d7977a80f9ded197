"""Turn raw conversations into training tables with Spark DataFrame plans."""

__version__ = "0.1.0"
