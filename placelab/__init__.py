"""placelab: place capture, cleaning and POI detection as Spark DataFrame jobs."""

__version__ = "0.1.0"
